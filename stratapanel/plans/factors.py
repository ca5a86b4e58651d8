"""The registry of the 120 factors and the plan that computes them.

A factor is a column expression over the panel and over columns of earlier stages. Windows can't be nested, so
intermediate columns (``_name``) have stages of their own; ``compute`` places each column in the stage after the last
one it needs. All time windows share one partitioning and order, so the stages cost one shuffle by ticker; ranks
of a day cost one by date, smoothing these another by ticker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.functions.aliases import resolve
from stratapanel.functions.expr import all_rows, EPS, so_far, by_ticker, adjusted_kurtosis, adjusted_skew, change, clip, diff, div, filled, grouped, lag, mean, mean_deviation, median, nonzero, pct_rank, roll, rolling_corr, std, trailing_rank, zscore
from stratapanel.operators.asof import asof_join
from stratapanel.operators.ewm import Ewm, add_ewm, span
from stratapanel.operators.rolling import add_trailing


@dataclass(frozen=True)
class Spec:
    name: str
    family: str
    build: Callable[[], Column]
    needs: tuple[str, ...] = ()
    fill: float | None = 0.0
    daily: bool = False


FACTORS: dict[str, Spec] = {}
PARTS: dict[str, Spec] = {}


def factor(name: str, family: str, build: Callable[[], Column], *needs: str, fill: float | None = 0.0) -> None:
    FACTORS[name] = Spec(name, family, build, needs, fill)


def part(name: str, build: Callable[[], Column], *needs: str, daily: bool = False) -> None:
    """``daily``: a window over the day's rows, not over a ticker's."""
    PARTS[name] = Spec(name, "part", build, needs, None, daily)


def list_factors(family: str | None = None) -> list[str]:
    return [n for n, s in FACTORS.items() if family in (None, s.family)]


c = F.col
YEAR = math.sqrt(252)

# ---- intermediate columns
part("_c", lambda: filled("close"))
part("_prev", lambda: lag("close"))
part("_r1", lambda: change("_c", 1), "_c")
for _n in (5, 10, 20, 21, 63, 126, 252):
    part(f"_r{_n}", lambda n=_n: change("_c", n), "_c")
part("_tr", lambda: F.greatest(c("high") - c("low"), F.abs(c("high") - c("_prev")), F.abs(c("low") - c("_prev"))), "_prev")
part("_up", lambda: diff("high"))
part("_down", lambda: -diff("low"))
part("_plus", lambda: F.when((c("_up") > c("_down")) & (c("_up") > 0), c("_up")).otherwise(0.0), "_up", "_down")
part("_minus", lambda: F.when((c("_down") > c("_up")) & (c("_down") > 0), c("_down")).otherwise(0.0), "_up", "_down")
part("_tp", lambda: (c("high") + c("low") + c("close")) / 3)
part("_dtp", lambda: diff("_tp"), "_tp")
part("_dc", lambda: diff("close"))
part("_dv", lambda: c("close") * c("volume"))
part("_illiq", lambda: div(F.abs(c("_r1")), c("_dv") + EPS), "_r1", "_dv")
part("_gk", lambda: 0.5 * F.pow(F.ln(nonzero(div("high", "low"))), F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(F.ln(nonzero(div("close", "open"))), F.lit(2.0)))
part("_mfv", lambda: div(c("close") - c("low") - (c("high") - c("close")), c("high") - c("low") + EPS) * c("volume"))
part("_pos", lambda: F.when(c("_dtp") > 0, c("_tp") * c("volume")).otherwise(0.0), "_dtp")
part("_neg", lambda: F.when(c("_dtp") < 0, c("_tp") * c("volume")).otherwise(0.0), "_dtp")
part("_ad", lambda: F.coalesce(div(c("close") - c("low") - (c("high") - c("close")), c("high") - c("low")), F.lit(0.0)) * c("volume"))
for _k, _col in (("oil", "oil_close"), ("usd", "usd_close"), ("y", "us_10y_close"), ("vix", "vix_close"), ("sp", "sp500_close")):
    part(f"_{_k}", lambda x=_col: filled(x))
    part(f"_{_k}5", lambda k=_k: change(f"_{k}", 5), f"_{_k}")
    part(f"_{_k}21", lambda k=_k: change(f"_{k}", 21), f"_{_k}")
    part(f"_{_k}63", lambda k=_k: change(f"_{k}", 63), f"_{_k}")


def smooth(x: str, n: int = 5, least: int = 1) -> Callable[[], Column]:
    return lambda: mean(x, n, least)


# ---- technical: momentum
for _n in (5, 10, 21, 63, 126, 252):
    factor(f"return_{_n}d", "momentum", lambda n=_n: c(f"_r{n}"), f"_r{_n}")
for _n in (10, 21):
    factor(f"mom_accel_{_n}d", "momentum", lambda n=_n: diff(f"_r{n}", n), f"_r{_n}")
part("_low14", lambda: roll(F.min, "low", 14))
part("_high14", lambda: roll(F.max, "high", 14))
factor("stoch_k", "momentum", lambda: 100 * div(c("close") - c("_low14"), c("_high14") - c("_low14")), "_low14", "_high14", fill=50.0)
factor("williams_r", "momentum", lambda: -100 * div(c("_high14") - c("close"), c("_high14") - c("_low14")), "_low14", "_high14", fill=-50.0)
factor("roc_20d", "momentum", lambda: c("_r20"), "_r20")

# ---- technical: exponential means, from the columns of one grouped pass
part("_gain", lambda: F.coalesce(F.greatest(c("_dc"), F.lit(0.0)), F.lit(0.0)), "_dc")
part("_loss", lambda: F.coalesce(F.greatest(-c("_dc"), F.lit(0.0)), F.lit(0.0)), "_dc")
part("_abs", lambda: F.abs(c("_dc")), "_dc")
part("_plus14", lambda: roll(F.sum, "_plus", 14), "_plus")
part("_minus14", lambda: roll(F.sum, "_minus", 14), "_minus")
part("_tr14", lambda: roll(F.sum, "_tr", 14), "_tr")
part("_pdi", lambda: div(100 * c("_plus14"), c("_tr14") + EPS), "_plus14", "_tr14")
part("_mdi", lambda: div(100 * c("_minus14"), c("_tr14") + EPS), "_minus14", "_tr14")
part("_dx", lambda: div(100 * F.abs(c("_pdi") - c("_mdi")), c("_pdi") + c("_mdi") + EPS), "_pdi", "_mdi")
part("_force", lambda: c("_dc") * c("volume"), "_dc")
part("_dv14", lambda: mean("_dv", 14), "_dv")
MEANS = [
    Ewm("_gain14", "_gain", 1 / 14, True, 14), Ewm("_loss14", "_loss", 1 / 14, True, 14), Ewm("_gain21", "_gain", 1 / 21, True, 21), Ewm("_loss21", "_loss", 1 / 21, True, 21),
    Ewm("_e12", "close", span(12)), Ewm("_e26", "close", span(26)), Ewm("_d25", "_dc", span(25)), Ewm("_d25_13", "_d25", span(13)), Ewm("_a25", "_abs", span(25)), Ewm("_a25_13", "_a25", span(13)),
    Ewm("_adx", "_dx", span(14)), Ewm("_force14", "_force", span(14)),
]
MEAN_INPUTS = ("_gain", "_loss", "_dc", "_abs", "_dx", "_force", "_dv14")


def _rsi(n: int) -> Column:
    return 100 - div(F.lit(100.0), 1 + div(f"_gain{n}", c(f"_loss{n}") + EPS))


EWM_FACTORS: dict[str, Callable[[], Column]] = {
    "rsi_14d": lambda: _rsi(14),
    "rsi_21": lambda: _rsi(21),
    "macd_12_26": lambda: c("_e12") - c("_e26"),
    "macd_signal_12_26_9": lambda: c("_macd9"),
    "tsi": lambda: 100 * div("_d25_13", "_a25_13"),
    "adx_14": lambda: c("_adx"),
    "force_index_14d": lambda: div("_force14", c("_dv14") + EPS),
}
for _name in EWM_FACTORS:
    factor(_name, "ewm", lambda n=_name: c(n))

# ---- technical: mean reversion
for _n in (5, 20, 21, 50, 63, 200):
    part(f"_sma{_n}", lambda n=_n: mean("close", n))
for _n in (21, 50, 200):
    factor(f"dist_sma_{_n}d", "mean_reversion", lambda n=_n: div(c("close") - c(f"_sma{n}"), c(f"_sma{n}") + EPS), f"_sma{_n}")
for _n in (21, 63):
    factor(f"zscore_{_n}d", "mean_reversion", lambda n=_n: zscore("close", n))
part("_sd20", lambda: std("close", 20))
factor("mr_bb_pos", "mean_reversion", lambda: div(c("close") - (c("_sma20") - 2 * c("_sd20")), 4 * c("_sd20") + EPS), "_sma20", "_sd20")
factor("mr_bb_width", "mean_reversion", lambda: div(4 * c("_sd20"), c("_sma20") + EPS), "_sma20", "_sd20")
factor("ma_cross_5_21", "mean_reversion", lambda: div(c("_sma5") - c("_sma21"), c("_sma21") + EPS), "_sma5", "_sma21")
factor("ma_cross_21_63", "mean_reversion", lambda: div(c("_sma21") - c("_sma63"), c("_sma63") + EPS), "_sma21", "_sma63")
part("_has_high", lambda: F.count("high").over(all_rows()))
part("_h", lambda: F.when(c("_has_high") == 0, c("close")).otherwise(c("high")), "_has_high")
part("_l", lambda: F.when(c("_has_high") == 0, c("close")).otherwise(c("low")), "_has_high")
part("_h252", lambda: roll(F.max, "_h", 252), "_h")
part("_l252", lambda: roll(F.min, "_l", 252), "_l")
factor("price_pos_52w", "mean_reversion", lambda: div(c("close") - c("_l252"), c("_h252") - c("_l252") + EPS), "_h252", "_l252")
part("_tp20", lambda: mean("_tp", 20), "_tp")
part("_mad", lambda: mean_deviation("_tp", 20), "_tp")
factor("cci_20", "mean_reversion", lambda: div(c("_tp") - c("_tp20"), c("_mad") * 0.015 + EPS), "_mad", "_tp20", "_tp")

# ---- technical: volume
factor("vol_zscore_21d", "volume", lambda: zscore("volume", 21))
factor("vol_ma20_ratio", "volume", lambda: div("volume", mean("volume", 20) + EPS))
factor("turnover_rate", "volume", lambda: F.ln(mean("_dv", 21) + EPS), "_dv")
factor("amihud_63d", "volume", lambda: mean("_illiq", 63) * 1e6, "_illiq")
factor("pv_corr_21d", "volume", lambda: rolling_corr("close", "volume", 21))
factor("cmf_21d", "volume", lambda: div(roll(F.sum, "_mfv", 21), roll(F.sum, "volume", 21) + EPS), "_mfv")
factor("mfi_14", "volume", lambda: 100 - div(F.lit(100.0), 1 + div(roll(F.sum, "_pos", 14), roll(F.sum, "_neg", 14) + EPS)), "_pos", "_neg")
factor("ad_line", "volume", lambda: div(F.sum("_ad").over(so_far()), F.sum("volume").over(all_rows()) + EPS), "_ad")

# ---- technical: volatility
for _n in (21, 63):
    factor(f"volatility_{_n}d", "volatility", lambda n=_n: std("_r1", n) * YEAR, "_r1")
for _n, _name in ((21, "gk_vol_21"), (63, "gk_val_63")):
    part(f"_gk{_n}", lambda n=_n: mean("_gk", n), "_gk")
    factor(_name, "volatility", lambda n=_n: F.sqrt(clip(f"_gk{n}", 0.0)) * YEAR, f"_gk{_n}")
for _n in (14, 21):
    factor(f"atr_{_n}", "volatility", lambda n=_n: div(mean("_tr", n), c("close") + EPS), "_tr")
factor("vol_ratio_5_21", "volatility", lambda: div(std("_r1", 5), std("_r1", 21) + EPS), "_r1")
factor("skew_21d", "volatility", lambda: adjusted_skew("_r1", 21), "_r1")
factor("kurt_21d", "volatility", lambda: adjusted_kurtosis("_r1", 21), "_r1")

# ---- alternative
for _k in ("oil", "y"):
    part(f"_{_k}21p", lambda k=_k: c(f"_{k}21") * 100, f"_{_k}21")
factor("alt_oil_momentum", "alternative", smooth("_oil21p"), "_oil21p")
part("_usd20", lambda: mean("usd_close", 20, 5))
factor("alt_usd_strength", "alternative", lambda: div(c("usd_close") - c("_usd20"), nonzero("_usd20") + 1e-6) * 100, "_usd20")
factor("alt_yield_trend", "alternative", lambda: c("_y63") * 100, "_y63")
part("_z_usd", lambda: zscore("usd_close", 252, 21, 1e-6))
part("_z_y63", lambda: zscore("_y63", 252, 21, 1e-6), "_y63")
part("_z_oil21", lambda: zscore("_oil21", 252, 21, 1e-6), "_oil21")
factor("alt_macro_score", "alternative", lambda: clip(50 + (c("_z_oil21") - c("_z_usd") + c("_z_y63")) / 3 * 15, 0, 100), "_z_usd", "_z_y63", "_z_oil21", fill=50.0)
part("_ou", lambda: div("oil_close", "usd_close"))
part("_ou_signal", lambda: (div("_ou", mean("_ou", 252, 63)) - 1) * 100, "_ou")
factor("alt_oil_usd_ratio", "alternative", smooth("_ou_signal"), "_ou_signal")
factor("alt_yield_momentum", "alternative", smooth("_y21p"), "_y21p")
part("_oil21s", smooth("_oil21"), "_oil21")
part("_y_min", lambda: roll(F.min, "us_10y_close", 252, 63))
part("_y_max", lambda: roll(F.max, "us_10y_close", 252, 63))
factor(
    "alt_inflation_proxy", "alternative",
    lambda: clip((clip(c("_oil21s") * 100, -50, 50) + 50) * 0.6 + div(c("us_10y_close") - c("_y_min"), c("_y_max") - c("_y_min") + 1e-6) * 100 * 0.4, 0, 100),
    "_oil21s", "_y_min", "_y_max",
)
part("_spread", lambda: c("_y21") - c("_oil21"), "_y21", "_oil21")
part("_z_spread", lambda: zscore("_spread", 63, 21, 1e-6), "_spread")
part("_z_spread5", smooth("_z_spread"), "_z_spread")
factor("alt_growth_inflation_mix", "alternative", lambda: clip("_z_spread5", -3, 3), "_z_spread5")
part("_vix_norm", lambda: clip((c("vix_close") - 10) / 30, 0, 1))
factor("alt_vix_level", "alternative", smooth("_vix_norm"), "_vix_norm")
part("_vix5p", lambda: c("_vix5") * 100, "_vix5")
factor("alt_vix_momentum", "alternative", smooth("_vix5p"), "_vix5p")
factor("alt_risk_on_off", "alternative", lambda: F.coalesce((c("vix_close") < 20) & (c("sp500_close") > mean("sp500_close", 50)), F.lit(False)).cast("double"))
factor("alt_volatility_stress", "alternative", lambda: c("_vix_norm") * 70 + clip("_vix5", 0, 1) * 30, "_vix_norm", "_vix5")

# ---- composite
part("_oil_med", lambda: median("oil_close", 252))
part("_usd_med", lambda: median("usd_close", 252))
part("_vix_rank", lambda: trailing_rank("vix_close", 252))
part("_vix5m", lambda: mean("vix_close", 5))
part("_y21m", lambda: mean("us_10y_close", 21, 5))
part("_y21f", lambda: mean("us_10y_close", 21))
part("_vix_s5", lambda: clip("_vix5m", 10, 40), "_vix5m")
part("_mam", lambda: c("_r21") * 100 * div(F.lit(25.0), "_vix_s5"), "_r21", "_vix_s5")
factor("comp_macro_momentum", "composite", smooth("_mam"), "_mam")
part("_ocv", lambda: div(F.lit(1.0), clip(nonzero("pe_ratio"), 1, 100)) * F.when(c("oil_close") < c("_oil_med"), 1.0).otherwise(0.5), "_oil_med")
factor("comp_oil_value", "composite", smooth("_ocv"), "_ocv")
part("_roe_f", lambda: filled("roe"))
part("_res", lambda: clip("_roe_f", -1, 1) * (1 - clip("_y21f", 0, 5) / 5), "_roe_f", "_y21f")
factor("comp_rate_quality", "composite", smooth("_res"), "_res")
part("_growth_f", lambda: filled("earnings_growth"))
part("_dag", lambda: clip("_growth_f", -1, 1) * F.when(c("usd_close") < c("_usd_med"), 1.0).otherwise(0.7), "_growth_f", "_usd_med")
factor("comp_dollar_growth", "composite", smooth("_dag"), "_dag")
part("_mom_rank", lambda: pct_rank("_r21"), "_r21", daily=True)
part("_rpb", lambda: (c("_mom_rank") + 1 - c("_vix_rank")) / 2, "_mom_rank", "_vix_rank")
factor("comp_risk_parity", "composite", smooth("_rpb"), "_rpb")
part("_mvd", lambda: c("_r21") - c("_vix21"), "_r21", "_vix21")
factor("comp_div_momentum_vix", "composite", smooth("_mvd", 10), "_mvd")
part("_inv_pe", lambda: div(F.lit(1.0), clip(nonzero("pe_ratio"), 1, 200)))
part("_pe_rank", lambda: pct_rank("_inv_pe"), "_inv_pe", daily=True)
part("_vyc", lambda: (c("_pe_rank") + 1 - clip("_y21m", 0.1, 5) / 5) / 2, "_pe_rank", "_y21m")
factor("comp_value_yield", "composite", smooth("_vyc"), "_vyc")
part("_qid", lambda: (clip("roe", -0.5, 0.5) - clip("debt_to_equity", 0, 5) * 0.1) * F.when(c("vix_close") - mean("vix_close", 63, 5) > 1e-9, 1.5).otherwise(1.0))
factor("comp_quality_stress", "composite", smooth("_qid"), "_qid")
factor("comp_earnings_macro", "composite", lambda: rolling_corr("pe_ratio", "_y21", 63, 10), "_y21")
_UP = lambda x: F.when(c(x) > mean(x, 21), 1).otherwise(-1)
part("_mao", lambda: ((_UP("oil_close") + _UP("us_10y_close") + _UP("usd_close")) / 3 + 1) * 50)
factor("comp_multi_asset", "composite", smooth("_mao", 5, 5), "_mao")
part("_sp200", lambda: mean("sp500_close", 200, 50))
factor(
    "comp_regime", "composite",
    lambda: F.when((c("sp500_close") > c("_sp200")) & (c("_sp21") > 0), 1.0).when(~F.coalesce(c("sp500_close") > c("_sp200"), F.lit(False)) & (c("_sp21") < 0), -1.0).otherwise(0.0), "_sp200", "_sp21",
)
part("_vix_m5", lambda: mean("vix_close", 5, 1))
factor("comp_vol_regime", "composite", lambda: F.when(c("_vix_m5") < 17, 0.0).when(c("_vix_m5") < 28, 1.0).when(c("_vix_m5") >= 28, 2.0), "_vix_m5")
part("_cfs", lambda: clip(((c("_oil21") + c("_usd21")) / 2 + 0.05) / 0.1, 0, 1) * 100, "_oil21", "_usd21")
factor("comp_capital_flow", "composite", smooth("_cfs"), "_cfs")
part("_ems", lambda: clip(((c("_y21") + c("_oil21") - c("_usd21")) / 3 + 0.04) / 0.08, 0, 1) * 100, "_oil21", "_usd21", "_y21")
factor("comp_econ_momentum", "composite", smooth("_ems"), "_ems")
part(
    "_phi",
    lambda: F.coalesce(c("sp500_close") > mean("sp500_close", 200), F.lit(False)).cast("double") * 25 + clip((35 - c("_vix5m")) / 20, 0, 1) * 25 + clip((c("_y21") + 0.02) / 0.04, 0, 1) * 50,
    "_y21", "_vix5m",
)
part("_phi5", lambda: mean("_phi", 5), "_phi")
factor("comp_health_index", "composite", lambda: clip("_phi5", 0, 100), "_phi5")

# ---- fundamental: plain or resolved columns, no fill


def _field(columns: list[str], key: str) -> Column | None:
    name = resolve(columns, key)
    return F.col(name) if name else None


def _ratio(num: Column | None, den: Column | None, low: float | None = None, high: float | None = None) -> Column | None:
    return None if num is None or den is None else clip(div(num, nonzero(den) + EPS), low, high)


SINGLE = {
    "qual_roe": ("roe", 1), "qual_roa": ("roa", 1), "qual_gross_margin": ("gross_margin", 1), "qual_op_margin": ("op_margin", 1), "qual_ebitda_margin": ("ebitda_margin", 1), "qual_profit_margin": ("profit_margin", 1),
    "qual_low_leverage": ("debt_equity", -1), "qual_low_beta": ("beta", -1), "growth_earnings_growth": ("earnings_growth", 1), "growth_rev_growth": ("rev_growth", 1), "health_debt_to_equity": ("debt_equity", -1),
    "health_current_ratio": ("current_ratio", 1), "health_quick_ratio": ("quick_ratio", 1),
}


def fundamental_columns(columns: list[str]) -> dict[str, Column]:
    """Each fundamental factor from the columns at hand; NULL where what it needs is absent."""
    f = {k: _field(columns, k) for k in (
        "pe_ratio", "forward_pe", "eps", "fwd_eps", "peg_ratio", "ps_ratio", "pb_ratio", "book_value", "ev_ebitda", "fcf", "ocf", "total_cash", "total_debt", "roe", "roa", "ebitda_margin", "debt_equity",
        "earnings_growth", "dividend", "buyback", "dividends_paid", "market_cap", "price", "total_revenue", "ebitda",
    )}
    has = lambda *keys: all(f[k] is not None for k in keys)
    over = lambda a, b: div(a, b + EPS)
    one, out = F.lit(1.0), {}
    for name, (key, sign) in SINGLE.items():
        x = _field(columns, key)
        out[name] = None if x is None else x if sign > 0 else -x
    out["val_earnings_yield"] = over(one, clip(f["pe_ratio"], 0.1, 200)) if has("pe_ratio") else over(f["eps"], f["price"]) if has("eps", "price") else None
    out["val_forward_earnings_yield"] = over(one, f["forward_pe"]) if has("forward_pe") else over(f["fwd_eps"], f["price"]) if has("fwd_eps", "price") else None
    out["val_book_yield"] = over(one, f["pb_ratio"]) if has("pb_ratio") else over(f["book_value"], f["price"]) if has("book_value", "price") else None
    out["val_fcf_yield"] = _ratio(f["fcf"], f["market_cap"])
    out["val_ocf_yield"] = _ratio(f["ocf"], f["market_cap"])
    out["val_dividend_yield"] = F.coalesce(f["dividend"], F.lit(0.0)) if has("dividend") else F.lit(0.0)
    paid = [F.abs(f[k]) for k in ("buyback", "dividends_paid") if has(k)]
    out["val_shareholder_yield"] = over(sum(paid, F.lit(0.0)), f["market_cap"]) if has("market_cap") else None
    debt = F.coalesce(f["total_debt"], F.lit(0.0)) if has("total_debt") else F.lit(0.0)
    value = f["market_cap"] + debt if has("market_cap") else None
    owed = f["debt_equity"] * over(f["market_cap"], f["pb_ratio"]) if not has("total_debt") and has("debt_equity", "pb_ratio", "market_cap") else debt
    out["val_ev_fcf_yield"] = over(f["fcf"], f["market_cap"] + owed) if has("fcf", "market_cap") else None
    out["val_ps_ratio"] = over(one, f["ps_ratio"]) if has("ps_ratio") else over(f["total_revenue"], f["market_cap"]) if has("total_revenue", "market_cap") else None
    out["val_ev_ebitda"] = over(one, f["ev_ebitda"]) if has("ev_ebitda") else over(f["total_revenue"] * f["ebitda_margin"], value) if has("total_revenue", "ebitda_margin", "market_cap") else None
    out["val_ev_sales"] = over(f["total_revenue"], value) if has("total_revenue", "market_cap") else None
    out["qual_fcf_conversion"] = _ratio(f["fcf"], f["ocf"])
    if has("ocf", "roa", "market_cap", "pe_ratio"):
        income = over(f["market_cap"], f["pe_ratio"])
        out["qual_accruals"] = -over(income - f["ocf"], over(income, f["roa"]))
    forward = f["fwd_eps"] if has("fwd_eps") else over(f["price"], f["forward_pe"]) if has("price", "forward_pe") else None
    out["growth_fwd_eps_growth"] = div(forward - f["eps"], F.abs(f["eps"]) + EPS) if forward is not None and has("eps") else None
    multiple = f["pe_ratio"] if has("pe_ratio") else over(f["price"], f["eps"]) if has("price", "eps") else None
    out["growth_peg_ratio"] = f["peg_ratio"] if has("peg_ratio") else over(multiple, f["earnings_growth"]) if multiple is not None and has("earnings_growth") else None
    out["growth_sgr"] = f["roe"] * (1 - clip((F.coalesce(f["dividend"], F.lit(0.0)) if has("dividend") else F.lit(0.0)) * f["pe_ratio"], 0, 1)) if has("roe", "pe_ratio") else None
    out["growth_reinvestment_rate"] = over(f["ocf"] - f["fcf"], f["ocf"]) if has("ocf", "fcf") else None
    out["health_cash_to_debt"] = _ratio(f["total_cash"], f["total_debt"], high=2)
    out["health_net_debt_ebitda"] = _ratio(f["total_debt"] - f["total_cash"], f["ebitda"], -1, 10) if has("total_debt", "total_cash") else None
    out["health_debt_to_revenue"] = _ratio(f["total_debt"], f["total_revenue"], high=5)
    out["health_ebitda_to_debt"] = _ratio(f["ebitda"], f["total_debt"], high=10)
    return {n: F.lit(None).cast("double") if out.get(n) is None else out[n].cast("double") for n in FUNDAMENTAL}


FUNDAMENTAL = (
    "val_earnings_yield", "val_forward_earnings_yield", "val_book_yield", "val_fcf_yield", "val_ocf_yield", "val_dividend_yield", "val_shareholder_yield", "val_ev_fcf_yield", "val_ps_ratio", "val_ev_ebitda", "val_ev_sales",
    "qual_roe", "qual_roa", "qual_gross_margin", "qual_op_margin", "qual_ebitda_margin", "qual_profit_margin", "qual_low_leverage", "qual_low_beta", "qual_fcf_conversion", "qual_accruals",
    "growth_earnings_growth", "growth_rev_growth", "growth_fwd_eps_growth", "growth_peg_ratio", "growth_sgr", "growth_reinvestment_rate",
    "health_debt_to_equity", "health_current_ratio", "health_quick_ratio", "health_cash_to_debt", "health_net_debt_ebitda", "health_debt_to_revenue", "health_ebitda_to_debt",
)
for _name in FUNDAMENTAL:
    factor(_name, "fundamental", lambda n=_name: c(n), fill=None)

# ---- earnings: windows over announcements, carried forward to the days after
EARNINGS = (
    "eps_sue_price", "earn_surprise_pct", "earn_streak", "earn_last_quarter_magnitude", "earn_beat_miss_momentum", "earn_eps_momentum", "earn_recent_positive_revisions", "earn_estimate_accuracy_trend",
    "earn_eps_acceleration", "est_consensus_strength", "est_surprise_consistency", "est_positive_confidence", "est_guidance_quality",
)
for _name in EARNINGS:
    factor(_name, "earnings", lambda n=_name: c(n))


def earnings_events(panel: DataFrame) -> DataFrame:
    """Rows whose reported earnings are new, with the surprise derived where it is missing."""
    known = panel.withColumn("_c", filled("close")).withColumn("_last", filled("eps_actual"))
    known = known.withColumn("_before", lag("_last")).where(c("eps_actual").isNotNull() & ~c("eps_actual").eqNullSafe(c("_before")))
    derived = div(c("eps_actual") - c("eps_estimate"), F.greatest(F.abs(c("eps_estimate")), F.lit(0.01)) + EPS) * 100
    derived = F.when(c("eps_estimate").isNotNull(), derived)
    return known.select("ticker", "date", "eps_actual", "eps_estimate", "_c", F.coalesce("surprise_pct", derived).alias("s"))


def add_earnings(panel: DataFrame) -> DataFrame:
    ev = earnings_events(panel).withColumn("beat", F.when(c("s").isNotNull(), (c("s") > 0).cast("double"))).withColumn("size", F.abs("s")).withColumn("hit", F.coalesce(c("s") > 0, F.lit(False)))
    ev = ev.withColumn("turn", F.coalesce(c("hit") != F.lag("hit").over(by_ticker()), F.lit(True)).cast("int"))
    ev = ev.withColumn("growth", div(diff("eps_actual"), F.greatest(F.abs(lag("eps_actual")), F.lit(0.01))) * 100).withColumn("run", F.sum("turn").over(by_ticker()))
    run = by_ticker().partitionBy("ticker", "run").orderBy("date")
    accuracy = clip(100 - median("size", 4, 2), 0, 100)
    made = {
        "eps_sue_price": clip(div(c("eps_actual") - c("eps_estimate"), F.when(c("_c") > 0, c("_c"))), -0.5, 0.5), "earn_surprise_pct": clip("s", -500, 500),
        "earn_streak": F.when(c("hit"), F.count(F.lit(1)).over(run).cast("double")).otherwise(0.0), "earn_last_quarter_magnitude": c("size"), "earn_beat_miss_momentum": mean("beat", 4, 2) * 100,
        "earn_eps_momentum": clip("growth", -500, 500), "earn_recent_positive_revisions": mean("beat", 3, 1) * 100, "earn_estimate_accuracy_trend": accuracy, "earn_eps_acceleration": clip(diff("growth"), -200, 200),
        "est_consensus_strength": accuracy, "est_surprise_consistency": div(F.lit(1.0), 1 + std("s", 4, 3) / 10), "est_positive_confidence": mean("beat", 6, 3) * 100, "est_guidance_quality": div(F.lit(1.0), 1 + mean("size", 4, 2) / 100),
    }
    ev = ev.select("ticker", "date", *(x.alias(n) for n, x in made.items()))
    ev = ev.select("ticker", "date", *(filled(n).alias(n) for n in EARNINGS))
    return asof_join(panel, ev, "ticker", "date", list(EARNINGS))


# ---- the plan


def _asks(spec: Spec) -> bool:
    """Whether the grouped pass makes figures of a column."""
    with grouped() as asked:
        spec.build()
    return bool(asked)


def stages(names: list[str], passes: bool = False) -> list[list[Spec]]:
    """The columns to compute, by stage: each after all it needs.

    All windows by ticker that need no rank of a day come first, then these ranks together, then what needs them, so
    rows are dealt by ticker, by date and by ticker again, however many factors there are. With ``passes``, which needs
    a session, columns with long frames go to as few grouped passes of such a phase as their needs allow.
    """
    place: dict[str, tuple[int, int, int]] = {}
    specs = {n: FACTORS.get(n) or PARTS[n] for n in names}

    def of(spec: Spec) -> tuple[int, int, int]:
        if spec.name not in place:
            below = [(PARTS[n].daily, of(PARTS[n])) for n in spec.needs]
            phase = max((p + daily for daily, (p, _, _) in below), default=0)
            here = [x for daily, x in below if x[0] == phase and not daily]
            after = max((k for _, k, _ in here), default=0) + (passes and not spec.daily and _asks(spec))
            depth = 1 + max((d for _, k, d in here if k == after), default=0)
            place[spec.name] = (phase, 1 << 20, 0) if spec.daily else (phase, after, depth)
        return place[spec.name]

    for spec in specs.values():
        of(spec)
    return [[specs.get(n) or PARTS[n] for n in place if place[n] == k] for k in sorted(set(place.values()))]


def _named(columns: list[Column]) -> set[str]:
    """The words of the columns' expressions, all names they read among them."""
    return set(re.findall(r"\w+", " ".join(map(str, columns))))


def add_stages(df: DataFrame, planned: list[list[Spec]], keep: set[str]) -> DataFrame:
    """Adds the columns of the stages; before a grouped pass, columns that neither a later stage nor ``keep`` reads go."""
    built = []
    for stage in planned:
        with grouped() as asked:
            built.append(([s.build().alias(s.name) for s in stage], list(asked.values())))
    for i, (columns, asked) in enumerate(built):
        if asked:
            read = keep | {x for a in asked for x in (a.x, a.y)} | _named([x for later, _ in built[i:] for x in later]) | {x for _, more in built[i:] for a in more for x in (a.x, a.y)}
            df = add_trailing(df.select(*(x for x in df.columns if x in read)), asked)
        df = df.select("*", *columns)
    return df


def finish(x: Column, fill: float | None) -> Column:
    """Infinite and NaN values become NULL, then the fill value; ``x`` is a plain column, as it is used several times."""
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    return x if fill is None else F.coalesce(x, F.lit(fill))


def compute(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(date, ticker, factors...): the named factors, or all."""
    names = list(names or FACTORS)
    by = {f: [n for n in names if FACTORS[n].family == f] for f in {s.family for s in FACTORS.values()}}
    df = panel
    if by["earnings"]:
        df = add_earnings(df)
    if by["fundamental"]:
        columns = fundamental_columns(panel.columns)
        df = df.select("*", *(columns[n].alias(n) for n in by["fundamental"]))
    windowed = [n for f in ("momentum", "mean_reversion", "volume", "volatility", "alternative", "composite") for n in by[f]]
    wanted = windowed + (list(MEAN_INPUTS) if by["ewm"] else [])
    df = add_stages(df, stages(wanted, passes=True), {"date", "ticker", "close", *names, *wanted})
    if by["ewm"]:
        df = df.select("date", "ticker", "close", *MEAN_INPUTS, *(n for n in names if n not in by["ewm"]))
        df = add_ewm(df, [*MEANS, Ewm("_macd9", "_macd", span(9))], derive={"_macd": ("_e12", "_e26")})
        df = df.select("*", *(EWM_FACTORS[n]().alias(n) for n in by["ewm"]))
    return df.select("date", "ticker", *(finish(c(n), FACTORS[n].fill).alias(n) for n in names))
