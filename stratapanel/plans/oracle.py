"""The panel and the factors as DuckDB SQL, written apart from the column expressions, for checks."""

from __future__ import annotations

import re

from stratapanel.sources.tables import REPORTING_LAG_DAYS, STATEMENT_FIELDS


def _field(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


BARS = """bars AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1, 2)"""
SECTORS = """sectors AS (
  SELECT s_suppkey AS ticker, r_name AS sector, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MACRO = """macro AS (
  SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 100 AS sp500_close, 10.0 + CAST(sum(o_orderkey) % 3000 AS DOUBLE) / 100 AS vix_close,
    CAST(0.5 AS DOUBLE) + CAST(max(o_orderkey) % 500 AS DOUBLE) / 100 AS us_10y_close, 20.0 + min(o_totalprice) / 1000 AS oil_close, CAST(80 + count(*) AS DOUBLE) AS usd_close
  FROM orders GROUP BY 1)"""
STATEMENTS = f"""sums AS (
  SELECT l_suppkey AS ticker, date_trunc('quarter', CAST(l_shipdate AS DATE)) AS quarter, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(sum(l_orderkey) AS DOUBLE) AS k, CAST(sum(l_partkey) AS DOUBLE) AS p,
    CAST(sum(l_linenumber) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2),
statements AS (
  SELECT ticker, CAST(quarter + INTERVAL 3 MONTH AS DATE) - 1 + {REPORTING_LAG_DAYS} AS date, {", ".join(f"{_field(x)} AS {k}" for k, x in STATEMENT_FIELDS.items())} FROM sums)"""
PANEL = f"""{BARS}, {SECTORS}, {MACRO}, {STATEMENTS},
panel AS (
  SELECT b.*, x.sector, x.industry, m.sp500_close, m.vix_close, m.us_10y_close, m.oil_close, m.usd_close, {", ".join(f"s.{k}" for k in STATEMENT_FIELDS)}
  FROM bars b LEFT JOIN sectors x ON b.ticker = x.ticker LEFT JOIN macro m ON b.date = m.date ASOF LEFT JOIN statements s ON b.ticker = s.ticker AND b.date >= s.date)"""


def over(x: str, n: int) -> str:
    return f"{x} OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, k: int | None = None) -> str:
    return f"(CASE WHEN {over(f'count({x})', n)} >= {k or n} THEN {over(f.format(x), n)} END)"


def mean(x: str, n: int, k: int | None = None) -> str:
    return roll("avg({})", x, n, k)


def std(x: str, n: int, k: int | None = None) -> str:
    return roll("stddev_samp({})", x, n, k)


def median(x: str, n: int, k: int | None = None) -> str:
    return roll("quantile_cont({}, 0.5)", x, n, k)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY date)"


def diff(x: str, n: int = 1) -> str:
    return f"({x} - {lag(x, n)})"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def change(x: str, n: int) -> str:
    return f"({div(x, lag(x, n))} - 1)"


def filled(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


def clip(x: str, low: float | None, high: float | None) -> str:
    cases = "" if low is None else f" WHEN ({x}) < {low} THEN CAST({low} AS DOUBLE)"
    cases += "" if high is None else f" WHEN ({x}) > {high} THEN CAST({high} AS DOUBLE)"
    return f"(CASE{cases} ELSE {x} END)"


def zscore(x: str, n: int, k: int | None = None, eps: str = "1e-9") -> str:
    return f"({x} - {mean(x, n, k)}) / ({std(x, n, k)} + {eps})"


def rank(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END)"


def corr(x: str, y: str, n: int, k: int) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    spread = f"nullif({over(f'stddev_pop({a})', n)} * {over(f'stddev_pop({b})', n)}, 0)"
    return f"(CASE WHEN {over(f'count({a})', n)} >= {k} THEN {over(f'covar_pop({x}, {y})', n)} / {spread} END)"


P: dict[str, str] = {"_c": filled("close"), "_prev": lag("close"), "_up": diff("high"), "_down": f"(-{diff('low')})", "_dc": diff("close"), "_tp": "(high + low + close) / 3", "_dv": "close * volume"}
P |= {f"_r{n}": change("_c", n) for n in (1, 5, 10, 20, 21, 63, 126, 252)}
P |= {
    "_tr": "greatest(high - low, abs(high - _prev), abs(low - _prev))", "_plus": "CASE WHEN _up > _down AND _up > 0 THEN _up ELSE 0.0 END", "_minus": "CASE WHEN _down > _up AND _down > 0 THEN _down ELSE 0.0 END",
    "_dtp": diff("_tp"), "_illiq": "abs(_r1) / (_dv + 1e-9)", "_gk": "0.5 * ln(high / low) ** 2 - (2 * ln(2.0) - 1) * ln(close / open) ** 2", "_mfv": "(close - low - (high - close)) / (high - low + 1e-9) * volume",
    "_pos": "CASE WHEN _dtp > 0 THEN _tp * volume ELSE 0.0 END", "_neg": "CASE WHEN _dtp < 0 THEN _tp * volume ELSE 0.0 END", "_ad": "coalesce((close - low - (high - close)) / nullif(high - low, 0), 0) * volume",
}
for _k, _x in (("oil", "oil_close"), ("usd", "usd_close"), ("y", "us_10y_close"), ("vix", "vix_close"), ("sp", "sp500_close")):
    P |= {f"_{_k}": filled(_x), f"_{_k}5": change(f"_{_k}", 5), f"_{_k}21": change(f"_{_k}", 21), f"_{_k}63": change(f"_{_k}", 63)}
P |= {
    "_low14": roll("min({})", "low", 14), "_high14": roll("max({})", "high", 14), "_sd20": std("close", 20), "_h252": roll("max({})", "high", 252), "_l252": roll("min({})", "low", 252), "_tp20": mean("_tp", 20),
    "_tps": over("list(_tp)", 20), "_mad": "list_sum(list_transform(_tps, lambda v: abs(v - _tp20))) / 20", "_oil21p": "_oil21 * 100", "_y21p": "_y21 * 100", "_usd20": mean("usd_close", 20, 5),
    "_z_usd": zscore("usd_close", 252, 21, "1e-6"), "_z_y63": zscore("_y63", 252, 21, "1e-6"), "_z_oil21": zscore("_oil21", 252, 21, "1e-6"), "_ou": "oil_close / nullif(usd_close, 0)",
    "_ou_signal": f"(_ou / {mean('_ou', 252, 63)} - 1) * 100", "_oil21s": mean("_oil21", 5, 1), "_y_min": roll("min({})", "us_10y_close", 252, 63), "_y_max": roll("max({})", "us_10y_close", 252, 63),
    "_spread": "_y21 - _oil21", "_z_spread": zscore("_spread", 63, 21, "1e-6"), "_vix_norm": clip("(vix_close - 10) / 30", 0, 1), "_vix5p": "_vix5 * 100", "_vix_s5": clip(mean("vix_close", 5), 10, 40),
    "_mam": "_r21 * 100 * (25.0 / _vix_s5)", "_oil_med": median("oil_close", 252), "_ocv": f"1.0 / {clip('nullif(pe_ratio, 0)', 1, 100)} * CASE WHEN oil_close < _oil_med THEN 1.0 ELSE 0.5 END", "_roe_f": filled("roe"),
    "_res": f"{clip('_roe_f', -1, 1)} * (1 - {clip(mean('us_10y_close', 21), 0, 5)} / 5)", "_usd_med": median("usd_close", 252), "_growth_f": filled("earnings_growth"),
    "_dag": f"{clip('_growth_f', -1, 1)} * CASE WHEN usd_close < _usd_med THEN 1.0 ELSE 0.7 END", "_mom_rank": rank("_r21"), "_vixs": over("list(vix_close) FILTER (WHERE vix_close IS NOT NULL)", 252),
    "_vix_rank": "CASE WHEN len(_vixs) >= 252 AND vix_close IS NOT NULL THEN (len(list_filter(_vixs, lambda v: v < vix_close)) + (len(list_filter(_vixs, lambda v: v = vix_close)) + 1) / 2.0) / len(_vixs) END",
    "_rpb": "(_mom_rank + 1 - _vix_rank) / 2", "_mvd": "_r21 - _vix21", "_inv_pe": f"1.0 / {clip('nullif(pe_ratio, 0)', 1, 200)}", "_pe_rank": rank("_inv_pe"), "_vyc": f"(_pe_rank + 1 - {clip(mean('us_10y_close', 21, 5), 0.1, 5)} / 5) / 2",
    "_qid": f"({clip('roe', -0.5, 0.5)} - {clip('debt_to_equity', 0, 5)} * 0.1) * CASE WHEN vix_close - {mean('vix_close', 63, 5)} > 1e-9 THEN 1.5 ELSE 1.0 END",
    "_mao": "((" + " + ".join(f"CASE WHEN {x} > {mean(x, 21)} THEN 1 ELSE -1 END" for x in ("oil_close", "us_10y_close", "usd_close")) + ") / 3.0 + 1) * 50", "_sp200": mean("sp500_close", 200, 50), "_vix_m5": mean("vix_close", 5, 1),
    "_cfs": clip("((_oil21 + _usd21) / 2 + 0.05) / 0.1", 0, 1) + " * 100", "_ems": clip("((_y21 + _oil21 - _usd21) / 3 + 0.04) / 0.08", 0, 1) + " * 100",
    "_phi": f"CASE WHEN sp500_close > {mean('sp500_close', 200)} THEN 25.0 ELSE 0.0 END + {clip('(35 - ' + mean('vix_close', 5) + ') / 20', 0, 1)} * 25 + {clip('(_y21 + 0.02) / 0.04', 0, 1)} * 50",
}
P |= {f"_sma{n}": mean("close", n) for n in (5, 20, 21, 50, 63, 200)}
P |= {"_gain": "coalesce(greatest(_dc, 0), 0)", "_loss": "coalesce(greatest(-_dc, 0), 0)", "_abs": "abs(_dc)", "_plus14": roll("sum({})", "_plus", 14), "_minus14": roll("sum({})", "_minus", 14), "_tr14": roll("sum({})", "_tr", 14)}
P |= {"_pdi": "100 * _plus14 / (_tr14 + 1e-9)", "_mdi": "100 * _minus14 / (_tr14 + 1e-9)", "_dx": "100 * abs(_pdi - _mdi) / (_pdi + _mdi + 1e-9)", "_force": "_dc * volume", "_dv14": mean("_dv", 14)}

FACTORS: dict[str, str] = {f"return_{n}d": f"_r{n}" for n in (5, 10, 21, 63, 126, 252)}
FACTORS |= {
    "mom_accel_10d": diff("_r10", 10), "mom_accel_21d": diff("_r21", 21), "stoch_k": "100 * ((close - _low14) / nullif(_high14 - _low14, 0))", "williams_r": "-100 * ((_high14 - close) / nullif(_high14 - _low14, 0))", "roc_20d": "_r20",
    "dist_sma_21d": "(close - _sma21) / (_sma21 + 1e-9)", "dist_sma_50d": "(close - _sma50) / (_sma50 + 1e-9)", "dist_sma_200d": "(close - _sma200) / (_sma200 + 1e-9)", "zscore_21d": zscore("close", 21), "zscore_63d": zscore("close", 63),
    "mr_bb_pos": "(close - (_sma20 - 2 * _sd20)) / (4 * _sd20 + 1e-9)", "mr_bb_width": "4 * _sd20 / (_sma20 + 1e-9)", "ma_cross_5_21": "(_sma5 - _sma21) / (_sma21 + 1e-9)", "ma_cross_21_63": "(_sma21 - _sma63) / (_sma63 + 1e-9)",
    "price_pos_52w": "(close - _l252) / (_h252 - _l252 + 1e-9)", "cci_20": "(_tp - _tp20) / (_mad * 0.015 + 1e-9)",
    "vol_zscore_21d": zscore("volume", 21), "vol_ma20_ratio": f"volume / ({mean('volume', 20)} + 1e-9)", "turnover_rate": f"ln({mean('_dv', 21)} + 1e-9)", "amihud_63d": f"{mean('_illiq', 63)} * 1e6", "pv_corr_21d": corr("close", "volume", 21, 21),
    "cmf_21d": f"{roll('sum({})', '_mfv', 21)} / ({roll('sum({})', 'volume', 21)} + 1e-9)", "mfi_14": f"100 - 100 / (1 + {roll('sum({})', '_pos', 14)} / ({roll('sum({})', '_neg', 14)} + 1e-9))",
    "ad_line": "sum(_ad) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) / (sum(volume) OVER (PARTITION BY ticker) + 1e-9)",
    "volatility_21d": f"{std('_r1', 21)} * sqrt(252.0)", "volatility_63d": f"{std('_r1', 63)} * sqrt(252.0)", "gk_vol_21": f"sqrt(greatest({mean('_gk', 21)}, 0 * {mean('_gk', 21)})) * sqrt(252.0)",
    "gk_val_63": f"sqrt(greatest({mean('_gk', 63)}, 0 * {mean('_gk', 63)})) * sqrt(252.0)", "atr_14": f"{mean('_tr', 14)} / (close + 1e-9)", "atr_21": f"{mean('_tr', 21)} / (close + 1e-9)", "vol_ratio_5_21": f"{std('_r1', 5)} / ({std('_r1', 21)} + 1e-9)",
    "skew_21d": roll("skewness({})", "_r1", 21), "kurt_21d": roll("kurtosis({})", "_r1", 21),
    "alt_oil_momentum": mean("_oil21p", 5, 1), "alt_usd_strength": "(usd_close - _usd20) / (nullif(_usd20, 0) + 1e-6) * 100", "alt_yield_trend": "_y63 * 100", "alt_macro_score": clip("50 + (_z_oil21 - _z_usd + _z_y63) / 3 * 15", 0, 100),
    "alt_oil_usd_ratio": mean("_ou_signal", 5, 1), "alt_yield_momentum": mean("_y21p", 5, 1),
    "alt_inflation_proxy": clip(f"({clip('_oil21s * 100', -50, 50)} + 50) * 0.6 + (us_10y_close - _y_min) / (_y_max - _y_min + 1e-6) * 100 * 0.4", 0, 100), "alt_growth_inflation_mix": clip(mean("_z_spread", 5, 1), -3, 3),
    "alt_vix_level": mean("_vix_norm", 5, 1), "alt_vix_momentum": mean("_vix5p", 5, 1), "alt_risk_on_off": f"CASE WHEN vix_close < 20 AND sp500_close > {mean('sp500_close', 50)} THEN 1.0 ELSE 0.0 END",
    "alt_volatility_stress": f"_vix_norm * 70 + {clip('_vix5', 0, 1)} * 30",
    "comp_macro_momentum": mean("_mam", 5, 1), "comp_oil_value": mean("_ocv", 5, 1), "comp_rate_quality": mean("_res", 5, 1), "comp_dollar_growth": mean("_dag", 5, 1), "comp_risk_parity": mean("_rpb", 5, 1),
    "comp_div_momentum_vix": mean("_mvd", 10, 1), "comp_value_yield": mean("_vyc", 5, 1), "comp_quality_stress": mean("_qid", 5, 1), "comp_earnings_macro": corr("pe_ratio", "_y21", 63, 10), "comp_multi_asset": mean("_mao", 5),
    "comp_regime": "CASE WHEN sp500_close > _sp200 AND _sp21 > 0 THEN 1.0 WHEN NOT coalesce(sp500_close > _sp200, false) AND _sp21 < 0 THEN -1.0 ELSE 0.0 END",
    "comp_vol_regime": "CASE WHEN _vix_m5 < 17 THEN 0.0 WHEN _vix_m5 < 28 THEN 1.0 WHEN _vix_m5 >= 28 THEN 2.0 END", "comp_capital_flow": mean("_cfs", 5, 1), "comp_econ_momentum": mean("_ems", 5, 1),
    "comp_health_index": clip(mean("_phi", 5), 0, 100),
}
FILLS = {"stoch_k": 50, "williams_r": -50, "alt_macro_score": 50}


def staged(wanted: dict[str, str], source: str) -> tuple[list[str], str]:
    """CTEs that compute the columns and what they need, stage by stage; and the name of the last one."""
    level: dict[str, int] = {}

    def place(name: str, text: str) -> int:
        if name not in level:
            level[name] = 1 + max((place(n, P[n]) for n in set(re.findall(r"\b_[a-z0-9_]+\b", text)) if n in P), default=0)
        return level[name]

    for name, text in wanted.items():
        place(name, text)
    ctes, last = [], source
    for k in range(1, max(level.values()) + 1):
        columns = ", ".join(f"{wanted.get(n) or P[n]} AS {n}" for n in level if level[n] == k)
        ctes.append(f"st{k} AS (SELECT *, {columns} FROM {last})")
        last = f"st{k}"
    return ctes, last


def family_sql(names: list[str], digits: int = 6) -> str:
    ctes, last = staged({n: FACTORS[n] for n in names}, "panel")
    out = ", ".join(f"round(coalesce({n}, {FILLS.get(n, 0)}), {digits}) + 0.0 AS {n}" for n in names)
    return f"WITH {PANEL}, {', '.join(ctes)} SELECT date, ticker, {out} FROM {last}"


def _ewm(ctes: list[str], name: str, source: str, x: str, alpha: str, adjust: bool = False, least: int = 1) -> str:
    """A CTE with an exponential mean as a weighted sum over all earlier rows that have the value from the first on."""
    keep = f"(1 - {alpha})"
    weight = f"CASE WHEN b.i = 1 {'AND false' if adjust else ''} THEN power({keep}, a.i - b.i) ELSE {'1.0' if adjust else alpha} * power({keep}, a.i - b.i) END"
    norm = f" / sum(power({keep}, a.i - b.i))" if adjust else ""
    ctes.append(f"n_{name} AS (SELECT ticker, date, {x} AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM {source} WHERE {x} IS NOT NULL)")
    ctes.append(f"{name} AS (SELECT a.ticker, a.date, CASE WHEN max(a.i) >= {least} THEN sum(b.x * ({weight})){norm} END AS v FROM n_{name} a JOIN n_{name} b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2)")
    return name


def ewm_sql() -> str:
    inputs = ("_gain", "_loss", "_dc", "_abs", "_dx", "_force", "_dv14")
    ctes, last = staged({n: P[n] for n in inputs}, "panel")
    span = lambda n: f"(2.0 / {n + 1})"
    for name, x, alpha, adjust, least in (
        ("gain14", "_gain", "(1.0 / 14)", True, 14), ("loss14", "_loss", "(1.0 / 14)", True, 14), ("gain21", "_gain", "(1.0 / 21)", True, 21), ("loss21", "_loss", "(1.0 / 21)", True, 21),
        ("e12", "close", span(12), False, 1), ("e26", "close", span(26), False, 1), ("d25", "_dc", span(25), False, 1), ("a25", "_abs", span(25), False, 1), ("adx", "_dx", span(14), False, 1), ("force14", "_force", span(14), False, 1),
    ):
        _ewm(ctes, name, last, x, alpha, adjust, least)
    ctes.append("macd AS (SELECT e12.ticker, e12.date, e12.v - e26.v AS v FROM e12 JOIN e26 ON e12.ticker = e26.ticker AND e12.date = e26.date)")
    for name, source, n in (("macd9", "macd", 9), ("d2513", "d25", 13), ("a2513", "a25", 13)):
        _ewm(ctes, name, source, "v", span(n))
    rsi = lambda n: f"100 - 100 / (1 + gain{n}.v / (loss{n}.v + 1e-9))"
    used = ("gain14", "loss14", "gain21", "loss21", "macd", "macd9", "d2513", "a2513", "adx", "force14")
    joins = " ".join(f"LEFT JOIN {u} ON {u}.ticker = t.ticker AND {u}.date = t.date" for u in used)
    columns = {
        "rsi_14d": (rsi(14), 6), "rsi_21": (rsi(21), 6), "macd_12_26": ("macd.v", 2), "macd_signal_12_26_9": ("macd9.v", 2), "tsi": ("100 * d2513.v / nullif(a2513.v, 0)", 6), "adx_14": ("adx.v", 6), "force_index_14d": ("force14.v / (t._dv14 + 1e-9)", 6),
    }
    out = ", ".join(f"round(coalesce({x}, 0), {d}) + 0.0 AS {n}" for n, (x, d) in columns.items())
    return f"WITH {PANEL}, {', '.join(ctes)} SELECT t.date, t.ticker, {out} FROM {last} t {joins}"


E = "1e-9"
FUNDAMENTAL = {
    "val_earnings_yield": f"1.0 / ({clip('pe_ratio', 0.1, 200)} + {E})", "val_forward_earnings_yield": f"1.0 / (forward_pe + {E})", "val_book_yield": f"1.0 / (pb_ratio + {E})", "val_fcf_yield": f"fcf / (nullif(market_cap, 0) + {E})",
    "val_ocf_yield": f"ocf / (nullif(market_cap, 0) + {E})", "val_dividend_yield": "coalesce(dividend, 0)", "val_shareholder_yield": f"(abs(buyback) + abs(dividends_paid)) / (market_cap + {E})",
    "val_ev_fcf_yield": f"fcf / (market_cap + coalesce(total_debt, 0) + {E})", "val_ps_ratio": f"1.0 / (ps_ratio + {E})", "val_ev_ebitda": f"1.0 / (ev_ebitda + {E})", "val_ev_sales": f"total_revenue / (market_cap + coalesce(total_debt, 0) + {E})",
    "qual_roe": "roe", "qual_roa": "roa", "qual_gross_margin": "gross_margin", "qual_op_margin": "op_margin", "qual_ebitda_margin": "ebitda_margin", "qual_profit_margin": "profit_margin", "qual_low_leverage": "-debt_to_equity",
    "qual_low_beta": "-beta", "qual_fcf_conversion": f"fcf / (nullif(ocf, 0) + {E})",
    "qual_accruals": f"-((market_cap / nullif(pe_ratio + {E}, 0) - ocf) / nullif(market_cap / nullif(pe_ratio + {E}, 0) / nullif(roa + {E}, 0) + {E}, 0))",
    "growth_earnings_growth": "earnings_growth", "growth_rev_growth": "rev_growth", "growth_fwd_eps_growth": f"(fwd_eps - eps) / (abs(eps) + {E})", "growth_peg_ratio": f"pe_ratio / nullif(earnings_growth + {E}, 0)",
    "growth_sgr": f"roe * (1 - {clip('coalesce(dividend, 0) * pe_ratio', 0, 1)})", "growth_reinvestment_rate": f"(ocf - fcf) / nullif(ocf + {E}, 0)", "health_debt_to_equity": "-debt_to_equity", "health_current_ratio": "current_ratio",
    "health_quick_ratio": "quick_ratio", "health_cash_to_debt": clip(f"total_cash / (nullif(total_debt, 0) + {E})", None, 2), "health_net_debt_ebitda": clip(f"(total_debt - total_cash) / (nullif(ebitda, 0) + {E})", -1, 10),
    "health_debt_to_revenue": clip(f"total_debt / (nullif(total_revenue, 0) + {E})", None, 5), "health_ebitda_to_debt": clip(f"ebitda / (nullif(total_debt, 0) + {E})", None, 10),
}


def fundamental_sql(names: list[str], digits: int = 4) -> str:
    return f"WITH {PANEL} SELECT date, ticker, {', '.join(f'round({FUNDAMENTAL[n]}, {digits}) + 0.0 AS {n}' for n in names)} FROM panel"


def earnings_sql() -> str:
    accuracy = clip("100 - " + median("size", 4, 2), 0, 100)
    made = {
        "eps_sue_price": clip("(eps_actual - eps_estimate) / CASE WHEN _c > 0 THEN _c END", -0.5, 0.5), "earn_surprise_pct": clip("s", -500, 500),
        "earn_streak": "CASE WHEN hit THEN CAST(count(*) OVER (PARTITION BY ticker, run ORDER BY date) AS DOUBLE) ELSE 0.0 END", "earn_last_quarter_magnitude": "size", "earn_beat_miss_momentum": mean("beat", 4, 2) + " * 100",
        "earn_eps_momentum": clip("growth", -500, 500), "earn_recent_positive_revisions": mean("beat", 3, 1) + " * 100", "earn_estimate_accuracy_trend": accuracy, "earn_eps_acceleration": clip(diff("growth"), -200, 200),
        "est_consensus_strength": accuracy, "est_surprise_consistency": f"1.0 / (1.0 + {std('s', 4, 3)} / 10)", "est_positive_confidence": mean("beat", 6, 3) + " * 100", "est_guidance_quality": f"1.0 / (1.0 + {mean('size', 4, 2)} / 100)",
    }
    return f"""WITH {PANEL},
k AS (SELECT *, {filled("close")} AS _c, {filled("eps_actual")} AS _last FROM panel),
k2 AS (SELECT *, {lag("_last")} AS _before FROM k),
e1 AS (SELECT ticker, date, _c, eps_actual, eps_estimate, coalesce(surprise_pct, CASE WHEN eps_estimate IS NOT NULL THEN (eps_actual - eps_estimate) / (greatest(abs(eps_estimate), 0.01) + 1e-9) * 100 END) AS s
  FROM k2 WHERE eps_actual IS NOT NULL AND eps_actual IS DISTINCT FROM _before),
e2 AS (SELECT *, CASE WHEN s IS NOT NULL THEN CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END END AS beat, abs(s) AS size, coalesce(s > 0, false) AS hit, {diff("eps_actual")} / greatest(abs({lag("eps_actual")}), 0.01) * 100 AS growth FROM e1),
e3 AS (SELECT *, CASE WHEN hit IS DISTINCT FROM {lag("hit")} THEN 1 ELSE 0 END AS turn FROM e2),
e4 AS (SELECT *, sum(turn) OVER (PARTITION BY ticker ORDER BY date) AS run FROM e3),
e5 AS (SELECT ticker, date, {", ".join(f"{x} AS {n}" for n, x in made.items())} FROM e4),
e6 AS (SELECT ticker, date, {", ".join(f"{filled(n)} AS {n}" for n in made)} FROM e5)
SELECT p.date, p.ticker, {", ".join(f"round(coalesce(e.{n}, 0), 6) + 0.0 AS {n}" for n in made)} FROM panel p ASOF LEFT JOIN e6 e ON p.ticker = e.ticker AND p.date >= e.date"""
