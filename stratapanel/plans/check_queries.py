"""Registered queries of statements, flags, targets and readiness, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.functions.expr import by_ticker
from stratapanel.operators import checks, statistics
from stratapanel.operators import portfolio as pf
from stratapanel.plans import monitor_queries, oracle, preprocessing
from stratapanel.plans.panel_queries import _EQ, SIGNALS_SQL, r, signals
from stratapanel.sources.tables import bars, macro, read, statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Line items as sums over a quarter: q, k, p and n are quantity, order, part and line numbers.
ITEM_FIELDS = {
    "revenue": "100.0 * q", "gross": "40.0 * q - p % 50", "operating": "CASE WHEN k % 5 = 0 THEN NULL ELSE 10.0 * q - k % 70 END", "ebit": "10.0 * q - n % 30", "ebitda": "12.0 * q", "income": "5.0 * q - k % 900 - 20", "assets": "500.0 + 300.0 * q",
    "equity": "100.0 + q - p % 80", "debt": "CASE WHEN n % 4 = 0 THEN NULL ELSE 10.0 * (n % 40) END", "current_assets": "50.0 + k % 90", "current_liabilities": "20.0 + p % 70", "inventory": "CASE WHEN k % 3 = 0 THEN NULL ELSE 1.0 * (k % 25) END",
    "cash": "5.0 * (p % 60)", "ocf": "1.0 * q + k % 50", "fcf": "1.0 * q - 100.0", "buyback": "0.0 - p % 30", "paid": "CASE WHEN n % 7 = 0 THEN NULL ELSE 0.0 - n % 20 END",
}
#: Figures of a name's latest report sheet, from its number.
INFO_FIELDS = {
    "price": "10.0 + s_suppkey % 7", "market_cap": "CASE WHEN s_suppkey % 13 = 0 THEN 0.0 ELSE 1000.0 * s_suppkey END", "pe": "1.0 * (s_suppkey % 40)", "forward_pe": "1.0 * (s_suppkey % 30)", "book": "s_suppkey * 37 % 2500 - 100.0",
    "eps": "s_suppkey % 9 - 3.0", "forward_eps": "s_suppkey % 11 - 4.0",
}


def line_items(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, item, fiscal_date, value): statements as they land, a row an item."""
    items = read(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_orderkey", "l_partkey", "l_linenumber"])
    sums = items.groupBy(F.col("l_suppkey").alias("ticker"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("fiscal_date")).agg(
        F.sum("l_quantity").cast("double").alias("q"), F.sum("l_orderkey").cast("double").alias("k"), F.sum("l_partkey").cast("double").alias("p"), F.sum("l_linenumber").cast("double").alias("n")
    )
    wide = sums.select("ticker", "fiscal_date", *(F.expr(f"cast({x} as double)").alias(preprocessing.ITEMS[name]) for name, x in ITEM_FIELDS.items()))
    return wide.unpivot(["ticker", "fiscal_date"], [F.col(f"`{preprocessing.ITEMS[name]}`") for name in ITEM_FIELDS], "item", "value")


_ITEMS = f"""{oracle.STATEMENTS}, w AS (SELECT ticker, CAST(quarter AS DATE) AS fiscal_date, {", ".join(f"CAST({x} AS DOUBLE) AS {name}" for name, x in ITEM_FIELDS.items())} FROM sums)"""
_EV = "nullif(cap + coalesce(debt, 0) - coalesce(cash, 0), 0)"
_RATIOS = {
    "val_earnings_yield": "CASE WHEN pe > 0.1 THEN 1.0 / least(greatest(pe, 0.1), 200) END", "val_forward_earnings_yield": "CASE WHEN forward_pe > 0.1 THEN 1.0 / least(greatest(forward_pe, 0.1), 200) END", "val_book_yield": "least(greatest(book, -1000), 1000) / nullif(price, 0)",
    "val_fcf_yield": "fcf / cap", "val_ocf_yield": "ocf / cap", "val_ps_ratio": "revenue / cap", "val_shareholder_yield": "(coalesce(abs(buyback), 0) + coalesce(abs(paid), 0)) / cap", "val_ev_fcf_yield": f"fcf / {_EV}", "val_ev_ebitda": f"ebitda / {_EV}", "val_ev_sales": f"revenue / {_EV}",
    "qual_roe": "income / nullif(equity, 0)", "qual_roa": "income / nullif(assets, 0)", "qual_gross_margin": "gross / nullif(revenue, 0)", "qual_op_margin": "coalesce(operating, ebit) / nullif(revenue, 0)", "qual_ebitda_margin": "ebitda / nullif(revenue, 0)",
    "qual_profit_margin": "income / nullif(revenue, 0)", "qual_low_leverage": "-(debt / nullif(equity, 0))", "qual_fcf_conversion": "fcf / nullif(ocf, 0)", "qual_accruals": "-((income - ocf) / nullif(assets, 0))", "health_current_ratio": "current_assets / nullif(current_liabilities, 0)",
    "health_quick_ratio": "(current_assets - coalesce(inventory, 0)) / nullif(current_liabilities, 0)", "health_debt_to_equity": "debt / nullif(equity, 0)", "growth_fwd_eps_growth": "(forward_eps - eps) / nullif(abs(eps), 0)",
    "growth_sgr": "income / nullif(equity, 0) * (1 - coalesce(abs(paid) / nullif(income, 0), 0.4))", "growth_reinvestment_rate": "(ocf - fcf) / nullif(ocf, 0)", "growth_rev_growth": "(revenue - revenue_before) / nullif(abs(revenue_before), 0)",
    "growth_earnings_growth": "(income - income_before) / nullif(abs(income_before), 0)",
}


@query(f"""WITH {_ITEMS}, i AS (SELECT s_suppkey AS ticker, {", ".join(f"CAST({x} AS DOUBLE) AS {name}" for name, x in INFO_FIELDS.items())} FROM supplier),
j AS (SELECT w.*, b.revenue AS revenue_before, b.income AS income_before, i.* EXCLUDE (ticker), CASE WHEN i.market_cap > 0 THEN i.market_cap END AS cap FROM w LEFT JOIN w b ON b.ticker = w.ticker AND CAST(b.fiscal_date + INTERVAL 12 MONTH AS DATE) = w.fiscal_date LEFT JOIN i ON i.ticker = w.ticker)
SELECT ticker, fiscal_date + 90 AS date, {", ".join(f"round({x}, 9) + 0.0 AS {name}" for name, x in _RATIOS.items())} FROM j""")
def statement_ratios(spark, d):
    """27 ratios of each statement, and growth against the year before, on the day the statement counts from."""
    info = read(spark, d, "supplier", ["s_suppkey"]).select(F.col("s_suppkey").alias("ticker"), *(F.expr(f"cast({x} as double)").alias(f"info_{name}") for name, x in INFO_FIELDS.items()))
    made = preprocessing.fundamentals(line_items(spark, d), info)
    return made.select("ticker", "date", *(r(name, 9).alias(name) for name in _RATIOS))


_TIERS = ("revenue", "operating", "debt", "inventory", "paid")


@query(f"WITH {_ITEMS}, " + "c AS (" + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count({x}) / CAST(count(*) AS DOUBLE) AS s FROM w" for x in _TIERS) + ") SELECT \"column\", round(s, 6) AS coverage, CASE WHEN s >= 0.8 THEN 'OK' WHEN s >= 0.5 THEN 'WARNING' ELSE 'ERROR' END AS status FROM c")
def statement_coverage(spark, d):
    wide = preprocessing.wide_statements(line_items(spark, d))
    return preprocessing.coverage_tiers(wide, list(_TIERS)).select("column", F.round("coverage", 6).alias("coverage"), "status")


@query(SIGNALS_SQL + """, q AS (SELECT date, quantile_cont(return_21d, 0.01) AS a, quantile_cont(return_21d, 0.99) AS b FROM sig WHERE date < DATE '1998-01-01' AND return_21d IS NOT NULL GROUP BY 1), dd AS (SELECT DISTINCT date FROM sig WHERE date >= DATE '1998-01-01'),
u AS (SELECT dd.date, q.a, q.b FROM dd ASOF LEFT JOIN q ON dd.date >= q.date), h AS (SELECT s.date, s.ticker, s.sector, CASE WHEN return_21d < u.a THEN u.a WHEN return_21d > u.b THEN u.b ELSE return_21d END AS x FROM sig s JOIN u ON s.date = u.date WHERE return_21d IS NOT NULL)
SELECT date, ticker, round((x - avg(x) OVER w) / (coalesce(nullif(stddev_samp(x) OVER w, 0), 1e-8) + 1e-8), 4) + 0.0 AS return_21d FROM h WINDOW w AS (PARTITION BY date, sector)""")
def fold_scaler(spark, d):
    """Bounds of the training days, then z-scores within sectors, on the days after."""
    s = signals(spark, d).where("return_21d is not null")
    scaler = preprocessing.FoldScaler(["return_21d"]).fit(s.where("date < date'1998-01-01'"))
    return scaler.transform(s.where("date >= date'1998-01-01'")).select("date", "ticker", r("return_21d", 4).alias("return_21d"))


@query(_EQ + """, w AS (SELECT date, ticker, sector, weight FROM eq), dd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM w)), m AS (SELECT date, ticker, weight AS x FROM w UNION ALL SELECT nd, ticker, -weight FROM w JOIN dd USING (date) WHERE nd IS NOT NULL),
c AS (SELECT date, sum(abs(x)) AS t FROM (SELECT date, ticker, sum(x) AS x FROM m GROUP BY 1, 2) GROUP BY 1), f AS (SELECT min(date) AS f FROM w), s AS (SELECT date, max(abs(x)) AS most FROM (SELECT date, sector, sum(weight) AS x FROM w GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT date, sum(weight) AS total, min(weight) AS least FROM w GROUP BY 1)
SELECT a.date, abs(total) <= 1e-6 AS dollar_neutral, abs(total - 1) <= 1e-6 AS fully_invested, least >= -1e-6 AS long_only, most <= 0.3 + 1e-6 AS sectors_within, round(CASE WHEN a.date <> f THEN t END, 6) + 0.0 AS turnover, a.date = f OR t <= 0.5 + 1e-6 AS turnover_within FROM a JOIN c USING (date) JOIN s USING (date), f""")
def weight_flags(spark, d):
    s = signals(spark, d)
    w = pf.equal_weights(s, "return_21d", 5).join(s.select("date", "ticker", "sector"), ["date", "ticker"])
    return checks.weight_flags(w, turnover_cap=0.5).withColumn("turnover", r("turnover"))


@query(f"""WITH {oracle.BARS}, {oracle.STATEMENTS}, a AS (SELECT DISTINCT ticker FROM bars WHERE ticker % 11 <> 0), b AS (SELECT DISTINCT ticker FROM statements WHERE ticker % 7 <> 0), j AS (SELECT a.ticker AS p, b.ticker AS f FROM a FULL JOIN b ON a.ticker = b.ticker),
t AS (SELECT count(p) AS n_prices, count(f) AS n_fundamentals, count(*) FILTER (WHERE f IS NULL) AS only_prices, count(*) FILTER (WHERE p IS NULL) AS only_fundamentals FROM j), x AS (SELECT min(date) AS first_day, max(date) AS last_day, count(close) / CAST(count(*) AS DOUBLE) AS coverage FROM bars WHERE ticker % 11 <> 0)
SELECT *, coalesce((n_prices - only_prices) / CAST(n_prices AS DOUBLE) >= 0.9 AND coverage >= 0.9, false) AS go FROM t, x""")
def readiness(spark, d):
    """Whether prices and statements fit together (every eleventh and every seventh name is left out)."""
    return checks.readiness(bars(spark, d).where("ticker % 11 <> 0"), statements(spark, d).where("ticker % 7 <> 0"))


@query(f"""WITH {oracle.BARS}, v AS (SELECT ticker, sum(close * volume) * CASE WHEN ticker % 4 = 0 THEN -1 WHEN ticker % 4 = 1 THEN 0.0001 ELSE 1 END AS x FROM bars GROUP BY 1)
SELECT ticker, CASE WHEN x < 0 THEN '-$' ELSE '$' END || CASE WHEN abs(x) >= 1e9 THEN format('{{:,.2f}}', abs(x) / 1e9) || 'B' WHEN abs(x) >= 1e6 THEN format('{{:,.2f}}', abs(x) / 1e6) || 'M' WHEN abs(x) >= 1e3 THEN format('{{:,.1f}}', abs(x) / 1e3) || 'K' ELSE format('{{:,.2f}}', abs(x)) END AS amount FROM v""")
def currency_amounts(spark, d):
    v = bars(spark, d).groupBy("ticker").agg(F.sum(F.col("close") * F.col("volume")).alias("x"))
    return v.select("ticker", checks.currency(F.col("x") * F.when(F.col("ticker") % 4 == 0, -1.0).when(F.col("ticker") % 4 == 1, 0.0001).otherwise(1.0)).alias("amount"))


@query(SIGNALS_SQL + """, s AS (SELECT date, ticker, raw_ret_5d - avg(raw_ret_5d) OVER (PARTITION BY date, sector) AS e, CASE WHEN count(raw_ret_5d) OVER w >= 21 THEN stddev_samp(raw_ret_5d) OVER w END AS sd FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
m AS (SELECT quantile_cont(sd, 0.5) AS m FROM s) SELECT date, ticker, round(e / (1 + coalesce(sd, m)), 6) + 0.0 AS target FROM s, m""")
def target_damped(spark, d):
    return checks.damped_target(signals(spark, d).select("date", "ticker", "sector", "raw_ret_5d")).select("date", "ticker", r("target").alias("target"))


@query(SIGNALS_SQL + f""", b AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM sig), c AS (SELECT date, ticker, sector, (close / nullif({oracle.mean("close", 20)}, 0) - 1) / nullif({oracle.std("ret", 20)}, 0) AS x FROM b),
q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM c), h AS (SELECT date, ticker, sector, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS x FROM c, q)
SELECT date, ticker, round((x - avg(x) OVER (PARTITION BY date, sector)) / nullif(stddev_samp(x) OVER (PARTITION BY date, sector), 0), 4) + 0.0 AS composite FROM h""")
def sector_composite(spark, d):
    return checks.sector_composite(signals(spark, d).select("date", "ticker", "sector", "close")).select("date", "ticker", r("composite", 4).alias("composite"))


@query(f"""WITH {oracle.MACRO}, x AS (SELECT *, sp500_close / nullif(lag(sp500_close) OVER (ORDER BY date), 0) - 1 AS r FROM macro)
SELECT date, round(CASE WHEN count(r) OVER w >= 63 THEN sum(r) OVER w END, 6) + 0.0 AS index_return, round(CASE WHEN count(vix_close) OVER w >= 63 THEN avg(vix_close) OVER w END, 6) AS mean_vix, round(CASE WHEN count(us_10y_close) OVER w >= 63 THEN avg(us_10y_close) OVER w END, 6) AS mean_yield FROM x WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def macro_for_earnings(spark, d):
    return checks.macro_for_earnings(macro(spark, d)).select("date", r("index_return").alias("index_return"), F.round("mean_vix", 6).alias("mean_vix"), F.round("mean_yield", 6).alias("mean_yield"))


@query(f"WITH x AS ({monitor_queries.ORACLES['alpha_decay']}), f AS (SELECT abs(arg_min(ic, horizon)) AS f FROM x) SELECT min(horizon) AS half_life FROM x, f WHERE abs(ic) <= f / 2")
def alpha_half_life(spark, d):
    decay = monitor_queries.alpha_decay(spark, d).withColumnRenamed("horizon", "lag")
    return spark.createDataFrame([(statistics.half_life(decay),)], "half_life int")


@query(f"WITH {oracle.BARS}, x AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM bars) SELECT ticker, date, close FROM x WHERE i <= 30 AND close IS NOT NULL")
def lookback_slice(spark, d):
    from pyspark.sql import Window

    rows = bars(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    return rows.where("i <= 30").dropna(subset=["close"]).select("ticker", "date", "close")


@query(SIGNALS_SQL + ", x AS (SELECT date, ticker, return_21d, lag(return_21d, 21) OVER (PARTITION BY ticker ORDER BY date) AS earlier FROM sig) SELECT date, ticker, round(return_21d, 6) + 0.0 AS now, round(earlier, 6) + 0.0 AS before FROM x WHERE return_21d IS NOT NULL AND earlier IS NOT NULL")
def lagged_pairs(spark, d):
    s = signals(spark, d).select("date", "ticker", F.col("return_21d").alias("now"), F.lag("return_21d", 21).over(by_ticker()).alias("before"))
    return s.dropna().select("date", "ticker", r("now").alias("now"), r("before").alias("before"))
