"""Registered queries of the panel operators, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapanel.functions.expr import by_day, by_ticker, div, lag, pct_rank
from stratapanel.operators import cross_section as xs
from stratapanel.operators import portfolio as pf
from stratapanel.operators import research, shaping
from stratapanel.operators.asof import asof_join
from stratapanel.operators.ewm import Ewm, add_ewm
from stratapanel.operators.execution import draw
from stratapanel.plans import factors, oracle
from stratapanel.sources.shared import shared_table
from stratapanel.sources.tables import bar_days, bars, macro, panel, read, sectors, statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x, digits: int = 6):
    """A result column rounded, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + 0.0


# ---- signals: three factors, the next returns and the sector on each bar
SIGNALS = ("zscore_21d", "return_21d", "volatility_21d")
_CTES, _LAST = oracle.staged({n: oracle.FACTORS[n] for n in SIGNALS}, "panel")
_LEAD = "least(greatest(lead(open, {}) OVER w / nullif(lead(open, 1) OVER w, 0) - 1, -0.5), 0.5)"
SIGNALS_SQL = f"""WITH {oracle.PANEL}, {", ".join(_CTES)},
sig AS MATERIALIZED (SELECT date, ticker, sector, open, close, volume, market_cap, roe, {", ".join(SIGNALS)},
  CASE WHEN lead(open, 6) OVER w IS NOT NULL THEN {_LEAD.format(6)} END AS raw_ret_5d, CASE WHEN lead(open, 1) OVER w IS NOT NULL THEN least(greatest(lead(open, 1) OVER w / nullif(open, 0) - 1, -0.5), 0.5) END AS pnl_return
  FROM {_LAST} WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, sector, open, close, volume, market_cap, roe, factors..., raw_ret_5d, pnl_return)."""
    return _signals(panel(spark, sf_dir), ["sector", "open", "close", "volume", "market_cap", "roe"])


def price_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals`` without what is joined to a bar: bars come sorted from their only shuffle, so windows need no other sort."""
    return _signals(bars(spark, sf_dir), ["open", "close", "volume"])


def learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, sector, factors..., raw_ret_5d) without statements and market series, as no feature needs them."""
    return _signals(bars(spark, sf_dir), []).join(sectors(spark, sf_dir).select("ticker", "sector"), "ticker", "left").select("date", "ticker", "sector", *SIGNALS, "raw_ret_5d")


def _signals(df: DataFrame, keep: list[str]) -> DataFrame:
    for stage in factors.stages(list(SIGNALS)):
        df = df.select("*", *(s.build().alias(s.name) for s in stage))
    df = df.withColumn("raw_ret_5d", shaping.forward_return(5)).withColumn("pnl_return", factors.clip(div(F.lead("open", 1).over(by_ticker()), "open") - 1, -0.5, 0.5))
    return df.select("date", "ticker", *keep, *SIGNALS, "raw_ret_5d", "pnl_return")


# ---- scans, filters, shaping


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-07-01' AND l_quantity > 10")
def scan_project_filter(spark, d):
    rows = read(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate", "l_quantity"])
    rows = rows.where("l_shipdate >= date'1998-01-01' and l_shipdate < date'1998-07-01' and l_quantity > 10")
    return rows.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query(f"WITH {oracle.BARS} SELECT * FROM bars")
def bars_ohlcv(spark, d):
    return bars(spark, d)


@query(f"WITH {oracle.MACRO} SELECT * FROM macro")
def macro_series(spark, d):
    return macro(spark, d)


@query(f"WITH {oracle.STATEMENTS} SELECT ticker, date, total_revenue, pe_ratio, roe, eps_actual, surprise_pct FROM statements")
def statements_point_in_time(spark, d):
    return statements(spark, d).select("ticker", "date", "total_revenue", "pe_ratio", "roe", "eps_actual", "surprise_pct")


@query("SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1")
def dedupe_keep_last(spark, d):
    rows = read(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    rows = rows.withColumn("date", F.to_date("l_shipdate"))
    last = shaping.keep_one(rows, ["l_suppkey", "date"], [F.desc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")])
    return last.select(F.col("l_suppkey").alias("ticker"), "date", F.col("l_extendedprice").alias("price"))


@query(f"WITH {oracle.BARS}, h AS (SELECT * FROM bars WHERE date < DATE '1999-01-01'), n AS (SELECT ticker, date, open, high, low, close * 2 AS close, volume FROM bars WHERE date >= DATE '1998-06-01') SELECT * FROM n UNION ALL SELECT h.* FROM h ANTI JOIN n ON h.ticker = n.ticker AND h.date = n.date")
def upsert_bars(spark, d):
    b = bars(spark, d)
    return shaping.upsert(b.where("date < date'1999-01-01'"), b.where("date >= date'1998-06-01'").withColumn("close", F.col("close") * 2), ["ticker", "date"])


@query(f"WITH {oracle.BARS}, v AS (SELECT *, quantile_cont(volume, 0.5) OVER w * quantile_cont(close, 0.5) OVER w AS dv FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT date, ticker, close FROM v WHERE dv >= 1000000")
def liquidity_filter(spark, d):
    return shaping.liquid(bars(spark, d)).select("date", "ticker", "close")


@query("SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) WHERE trim(w) <> ''")
def explode_split(spark, d):
    return read(spark, d, "part", ["p_type"]).select(F.explode(F.split("p_type", " ")).alias("word")).select(F.trim("word").alias("word")).where("word <> ''").distinct()


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_extract(spark, d):
    return read(spark, d, "events", ["event_type", "props"]).groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'Unknown') AS industry FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 3 <> 0")
def fill_unknown(spark, d):
    n = read(spark, d, "nation").where("n_nationkey % 3 <> 0")
    s = read(spark, d, "supplier")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("Unknown")).alias("industry"))


@query(f"WITH {oracle.BARS} SELECT ticker, year(date) AS year, month(date) AS month, last(close ORDER BY date) AS close FROM bars GROUP BY ALL")
def resample_month_end(spark, d):
    return bars(spark, d).groupBy("ticker", F.year("date").cast("bigint").alias("year"), F.month("date").cast("bigint").alias("month")).agg(F.max_by("close", "date").alias("close"))


@query(f"WITH {oracle.BARS}, {oracle.SECTORS} SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(volume) FILTER (WHERE sector = 'AFRICA') AS \"AFRICA\", sum(volume) FILTER (WHERE sector = 'AMERICA') AS \"AMERICA\", sum(volume) FILTER (WHERE sector = 'ASIA') AS \"ASIA\", sum(volume) FILTER (WHERE sector = 'EUROPE') AS \"EUROPE\", sum(volume) FILTER (WHERE sector = 'MIDDLE EAST') AS \"MIDDLE EAST\" FROM bars JOIN sectors USING (ticker) GROUP BY 1")
def pivot_sector_volume(spark, d):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return bars(spark, d).join(sectors(spark, d), "ticker").groupBy(F.trunc("date", "month").alias("month")).pivot("sector", names).agg(F.sum("volume"))


@query(f"WITH {oracle.STATEMENTS} SELECT ticker, date, item, value FROM (UNPIVOT (SELECT ticker, date, total_revenue, fcf, ocf FROM statements) ON total_revenue, fcf, ocf INTO NAME item VALUE value)")
def unpivot_statements(spark, d):
    return statements(spark, d).unpivot(["ticker", "date"], ["total_revenue", "fcf", "ocf"], "item", "value")


# ---- joins


@query(SIGNALS_SQL + " SELECT a.date, a.ticker, a.zscore_21d > 0 AS up, round(a.pnl_return, 6) + 0.0 AS pnl FROM sig a WHERE a.zscore_21d IS NOT NULL AND a.pnl_return IS NOT NULL")
def inner_join_pred_ret(spark, d):
    s = signals(spark, d)
    left, right = s.select("date", "ticker", "zscore_21d").where("zscore_21d is not null"), s.select("date", "ticker", "pnl_return").where("pnl_return is not null")
    return left.join(right, ["date", "ticker"]).select("date", "ticker", (F.col("zscore_21d") > 0).alias("up"), r("pnl_return").alias("pnl"))


@query(f"WITH {oracle.BARS}, {oracle.MACRO}, j AS (SELECT b.date, b.ticker, m.vix_close FROM bars b LEFT JOIN macro m ON b.date = m.date) SELECT date, ticker, last_value(vix_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix FROM j")
def left_join_macro_filled(spark, d):
    j = bars(spark, d).join(macro(spark, d), "date", "left")
    return j.select("date", "ticker", factors.filled("vix_close").alias("vix"))


@query(SIGNALS_SQL + """, u AS (SELECT date, ticker, unnest([CASE WHEN zscore_21d > 0 THEN {'x': zscore_21d, 'y': NULL} END, CASE WHEN return_21d > 0 THEN {'x': NULL, 'y': return_21d} END]) AS v FROM sig)
SELECT date, ticker, round(max(v.x), 6) AS x, round(max(v.y), 6) AS y FROM u WHERE v IS NOT NULL GROUP BY 1, 2""")
def full_outer_models(spark, d):
    s = signals(spark, d)
    a = s.where("zscore_21d > 0").select("date", "ticker", F.round("zscore_21d", 6).alias("x"))
    return a.join(s.where("return_21d > 0").select("date", "ticker", F.round("return_21d", 6).alias("y")), ["date", "ticker"], "outer")


_MEMBERS = "m AS (SELECT ticker, date_trunc('month', date) AS month FROM bars GROUP BY 1, 2 HAVING sum(volume) >= 100)"


def _members(spark, d):
    return bars(spark, d).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.sum("volume").alias("v")).where("v >= 100").select("ticker", "month")


@query(f"WITH {oracle.BARS}, {_MEMBERS} SELECT b.date, b.ticker, b.close FROM bars b SEMI JOIN m ON b.ticker = m.ticker AND date_trunc('month', b.date) = m.month")
def semi_membership(spark, d):
    return bars(spark, d).withColumn("month", F.trunc("date", "month")).join(_members(spark, d), ["ticker", "month"], "left_semi").select("date", "ticker", "close")


@query(f"WITH {oracle.BARS}, {_MEMBERS} SELECT b.date, b.ticker, b.close FROM bars b ANTI JOIN m ON b.ticker = m.ticker AND date_trunc('month', b.date) = m.month")
def anti_missing(spark, d):
    return bars(spark, d).withColumn("month", F.trunc("date", "month")).join(_members(spark, d), ["ticker", "month"], "left_anti").select("date", "ticker", "close")


@query(f"WITH {oracle.BARS}, {oracle.STATEMENTS} SELECT b.date, b.ticker, b.close, s.total_revenue, s.pe_ratio, s.dividend FROM bars b ASOF LEFT JOIN statements s ON b.ticker = s.ticker AND b.date >= s.date")
def asof_fundamentals(spark, d):
    return asof_join(bars(spark, d), statements(spark, d), "ticker", "date", ["total_revenue", "pe_ratio", "dividend"]).select("date", "ticker", "close", "total_revenue", "pe_ratio", "dividend")


@query(f"WITH {oracle.BARS}, {oracle.STATEMENTS}, j AS (SELECT b.date, b.ticker, s.date AS sd, s.roe FROM bars b ASOF LEFT JOIN statements s ON b.ticker = s.ticker AND b.date > s.date) SELECT date, ticker, CASE WHEN date - sd <= 60 THEN roe END AS roe FROM j")
def asof_strict_tolerance(spark, d):
    return asof_join(bars(spark, d), statements(spark, d), "ticker", "date", ["roe"], tolerance_days=60, exact=False).select("date", "ticker", "roe")


@query("SELECT a.event_id, b.event_id AS last_click FROM events a ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts > b.ts WHERE a.event_type = 'purchase'")
def asof_events(spark, d):
    e = read(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_click"))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["last_click"], exact=False).select("event_id", "last_click")


@query(SIGNALS_SQL + ", k AS (SELECT date, ticker, return_21d, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM sig WHERE return_21d IS NOT NULL) SELECT date, ticker, (return_21d > 0) = (lag(return_21d) OVER (PARTITION BY ticker ORDER BY date) > 0) AS stable FROM k QUALIFY lag(return_21d) OVER (PARTITION BY ticker ORDER BY date) IS NOT NULL")
def self_join_signal_stability(spark, d):
    k = signals(spark, d).where("return_21d is not null").select("date", "ticker", "return_21d", F.row_number().over(by_ticker()).alias("i"))
    a, b = k.alias("a"), k.withColumn("i", F.col("i") + 1).alias("b")
    return a.join(b, ["ticker", "i"]).select("a.date", "ticker", ((F.col("a.return_21d") > 0) == (F.col("b.return_21d") > 0)).alias("stable"))


@query(f"WITH {oracle.STATEMENTS} SELECT a.ticker, a.quarter, round((CAST(a.q AS DOUBLE) - b.q) / nullif(abs(b.q), 0), 6) + 0.0 AS yoy FROM sums a JOIN sums b ON a.ticker = b.ticker AND b.quarter = a.quarter - INTERVAL 1 YEAR")
def yoy_self_join(spark, d):
    q = read(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"]).groupBy(F.col("l_suppkey").alias("ticker"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("quarter")).agg(F.sum("l_quantity").alias("q"))
    before = q.select("ticker", F.add_months("quarter", 12).alias("quarter"), F.col("q").alias("p"))
    return q.join(before, ["ticker", "quarter"]).select("ticker", "quarter", r(div(F.col("q") - F.col("p"), F.abs("p"))).alias("yoy"))


# ---- windows outside the registry


@query(SIGNALS_SQL + " SELECT date, ticker, round(raw_ret_5d, 6) + 0.0 AS raw_ret_5d, round(pnl_return, 6) + 0.0 AS pnl_return FROM sig")
def forward_returns(spark, d):
    return signals(spark, d).select("date", "ticker", r("raw_ret_5d").alias("raw_ret_5d"), r("pnl_return").alias("pnl_return"))


@query(f"WITH {oracle.BARS}, l AS (SELECT *, close / lag(close) OVER w AS q, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS hi FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT date, ticker, round(ln(q), 6) + 0.0 AS log_return, round((close - hi) / hi, 6) + 0.0 AS drawdown FROM l")
def log_returns_drawdown(spark, d):
    return bars(spark, d).select("date", "ticker", r(F.ln(div("close", lag("close")))).alias("log_return"), r(research.drawdown("close")).alias("drawdown"))


@query(f"""WITH {oracle.BARS}, a AS (SELECT date, ticker, close < 0.8 * max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS under FROM bars),
b AS (SELECT *, CASE WHEN under IS DISTINCT FROM lag(under) OVER (PARTITION BY ticker ORDER BY date) THEN 1 ELSE 0 END AS t FROM a), c AS (SELECT *, sum(t) OVER (PARTITION BY ticker ORDER BY date) AS run FROM b)
SELECT ticker, min(date) AS first_day, max(date) AS last_day, count(*) AS n_days FROM c WHERE under GROUP BY ticker, run""")
def drawdown_episodes(spark, d):
    rows = bars(spark, d).select("date", "ticker", (F.col("close") < 0.8 * F.max("close").over(factors.so_far())).alias("under"))
    return shaping.episodes(rows, "under").where("under").groupBy("ticker", "run").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("run")


@query(f"WITH {oracle.PANEL}, x AS (SELECT date, ticker, close / lag(close) OVER w - 1 AS a, sp500_close / nullif(lag(sp500_close) OVER w, 0) - 1 AS b FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)), y AS (SELECT date, ticker, CASE WHEN b IS NOT NULL THEN a END AS a, CASE WHEN a IS NOT NULL THEN b END AS b FROM x) SELECT date, ticker, round(CASE WHEN count(a) OVER f >= 30 THEN covar_samp(a, b) OVER f / nullif(var_samp(b) OVER f, 0) END, 5) + 0.0 AS beta FROM y WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rolling_beta(spark, d):
    x = panel(spark, d).select("date", "ticker", (div("close", lag("close")) - 1).alias("a"), (div("sp500_close", lag("sp500_close")) - 1).alias("b"))
    return research.rolling_beta(x, "a", "b").select("date", "ticker", r("beta", 5).alias("beta"))


@query(f"""WITH {oracle.BARS}, a AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS x FROM bars), b AS (SELECT *, {oracle.std("x", 20)} * sqrt(252.0) AS v, {oracle.mean("close", 200)} AS sma FROM a),
c AS (SELECT *, {oracle.median("v", 252)} AS med FROM b) SELECT date, ticker, CASE WHEN close > sma THEN 'Bull' ELSE 'Bear' END || '_' || CASE WHEN v > med THEN 'HighVol' ELSE 'LowVol' END AS regime FROM c""")
def regime_trend_vol(spark, d):
    return research.trend_vol_regime(bars(spark, d))


_PRED = SIGNALS_SQL + ", p AS (SELECT date, ticker, zscore_21d AS pred, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM sig WHERE zscore_21d IS NOT NULL)"


@query(_PRED + " SELECT a.date, a.ticker, round(sum(b.pred * CASE WHEN b.i = 1 THEN power(0.7, a.i - b.i) ELSE 0.3 * power(0.7, a.i - b.i) END), 6) + 0.0 AS smooth FROM p a JOIN p b ON a.ticker = b.ticker AND b.i <= a.i GROUP BY 1, 2")
def alpha_smoothing(spark, d):
    p = signals(spark, d).where("zscore_21d is not null").select("date", "ticker", "zscore_21d")
    return add_ewm(p, [Ewm("smooth", "zscore_21d", 0.3)]).select("date", "ticker", r("smooth").alias("smooth"))


@query(SIGNALS_SQL + " SELECT date, ticker, round(lag(zscore_21d) OVER (PARTITION BY ticker ORDER BY date), 6) + 0.0 AS signal FROM sig QUALIFY lag(zscore_21d) OVER (PARTITION BY ticker ORDER BY date) IS NOT NULL")
def trading_lag(spark, d):
    return signals(spark, d).select("date", "ticker", r(lag("zscore_21d")).alias("signal")).where("signal is not null")


# ---- cross-section


@query(SIGNALS_SQL + ", q AS (SELECT date, quantile_cont(return_21d, 0.01) AS a, quantile_cont(return_21d, 0.99) AS b FROM sig GROUP BY 1) SELECT s.date, s.ticker, round(CASE WHEN return_21d < a THEN a WHEN return_21d > b THEN b ELSE return_21d END, 6) + 0.0 AS return_21d FROM sig s JOIN q ON s.date = q.date")
def winsorize_xs(spark, d):
    return xs.winsorize(signals(spark, d), ["return_21d"]).select("date", "ticker", r("return_21d").alias("return_21d"))


@query(SIGNALS_SQL + " SELECT date, ticker, round(CASE WHEN count(return_21d) OVER w >= 3 AND stddev_samp(return_21d) OVER w > 1e-9 THEN coalesce((return_21d - avg(return_21d) OVER w) / stddev_samp(return_21d) OVER w, 0) ELSE 0 END, 6) + 0.0 AS return_21d FROM sig WINDOW w AS (PARTITION BY date)")
def zscore_xs(spark, d):
    return xs.zscore_day(signals(spark, d), ["return_21d"]).select("date", "ticker", r("return_21d").alias("return_21d"))


@query(SIGNALS_SQL + " SELECT date, ticker, sector, round((return_21d - avg(return_21d) OVER w) / (coalesce(nullif(stddev_samp(return_21d) OVER w, 0), 1e-8) + 1e-8), 5) + 0.0 AS return_21d FROM sig WHERE return_21d IS NOT NULL WINDOW w AS (PARTITION BY date, sector)")
def sector_neutral(spark, d):
    return xs.sector_neutral(signals(spark, d).where("return_21d is not null"), ["return_21d"]).select("date", "ticker", "sector", r("return_21d", 5).alias("return_21d"))


@query(SIGNALS_SQL + f" SELECT date, ticker, round(coalesce({oracle.rank('return_21d')}, 0.5), 6) + 0.0 AS return_21d FROM sig")
def pct_rank_xs(spark, d):
    return xs.rank_day(signals(spark, d), ["return_21d"]).select("date", "ticker", r("return_21d").alias("return_21d"))


_EDGES = "e AS (SELECT date, list_distinct(list_sort(quantile_cont(return_21d, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e0 FROM sig WHERE return_21d IS NOT NULL AND raw_ret_5d IS NOT NULL GROUP BY 1), f AS (SELECT date, list_sort(e0) AS e FROM e)"


@query(SIGNALS_SQL + f", {_EDGES}, b AS (SELECT s.date, raw_ret_5d, 1 + len(list_filter(e[2:len(e) - 1], lambda v: v < return_21d)) AS bucket FROM sig s JOIN f ON s.date = f.date WHERE return_21d IS NOT NULL AND raw_ret_5d IS NOT NULL AND len(e) > 1) SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(raw_ret_5d), 6) + 0.0 AS mean_return, count(*) AS n_rows FROM b GROUP BY 1")
def qcut_quantile_returns(spark, d):
    return research.quantile_returns(signals(spark, d), "return_21d", "raw_ret_5d").select("bucket", r("mean_return").alias("mean_return"), "n_rows")


@query(SIGNALS_SQL + " SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY return_21d DESC, ticker) AS place FROM sig WHERE return_21d IS NOT NULL QUALIFY place <= 5")
def topn_per_date(spark, d):
    return xs.top_n(signals(spark, d), "return_21d", 5).select("date", "ticker", F.col("place").cast("bigint").alias("place"))


@query(SIGNALS_SQL + f", k AS (SELECT date, ticker, coalesce({oracle.rank('zscore_21d')}, 0) AS a, coalesce({oracle.rank('return_21d')}, 0) AS b, coalesce({oracle.rank('volatility_21d')}, 0) AS c FROM sig) SELECT date, ticker, round(0.4 * a + 0.3 * b + 0.3 * c, 6) + 0.0 AS raw_alpha FROM k")
def ensemble_rank_blend(spark, d):
    return xs.blend(signals(spark, d), {"zscore_21d": 0.4, "return_21d": 0.3, "volatility_21d": 0.3}).select("date", "ticker", r("raw_alpha").alias("raw_alpha"))


_SECTOR = ", m AS (SELECT *, coalesce(avg(raw_ret_5d) OVER w, 0) AS sm, stddev_samp(raw_ret_5d) OVER w AS sd FROM sig WINDOW w AS (PARTITION BY date, sector)), q AS (SELECT date, quantile_cont(sd, 0.95) AS q FROM (SELECT DISTINCT date, sector, sd FROM m) GROUP BY 1), c AS (SELECT date, max(q) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cap FROM q)"


@query(SIGNALS_SQL + _SECTOR + " SELECT m.date, m.ticker, round(CASE WHEN sd > cap + 1e-12 THEN 0.5 ELSE 1.0 END * (raw_ret_5d - sm), 6) + 0.0 AS target FROM m LEFT JOIN c ON m.date = c.date")
def target_sector_residual(spark, d):
    return xs.sector_residual_target(signals(spark, d)).select("date", "ticker", r("target").alias("target"))


@query(SIGNALS_SQL + """, q AS (SELECT date, quantile_cont(return_21d, 0.01) AS a, quantile_cont(return_21d, 0.99) AS b FROM sig WHERE date < DATE '1999-01-01' GROUP BY 1), dd AS (SELECT DISTINCT date FROM sig WHERE date >= DATE '1998-01-01'),
u AS (SELECT dd.date, coalesce(q.date IS NOT NULL, false) AS hit, q.a, q.b FROM dd ASOF LEFT JOIN q ON dd.date >= q.date)
SELECT s.date, s.ticker, round(CASE WHEN return_21d < u.a THEN u.a WHEN return_21d > u.b THEN u.b ELSE return_21d END, 6) + 0.0 AS return_21d FROM sig s JOIN u ON s.date = u.date""")
def asof_date_scaler(spark, d):
    s = signals(spark, d)
    bounds = xs.date_scaler(s.where("date < date'1999-01-01'"), ["return_21d"])
    return xs.apply_date_scaler(s.where("date >= date'1998-01-01'"), bounds, ["return_21d"]).select("date", "ticker", r("return_21d").alias("return_21d"))


# ---- research
_RANKS = SIGNALS_SQL + """, l AS (SELECT date, unnest(['zscore_21d', 'return_21d', 'volatility_21d']) AS factor, unnest([zscore_21d, return_21d, volatility_21d]) AS v, raw_ret_5d AS t FROM sig),
k AS (SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY v) + (count(*) OVER (PARTITION BY factor, date, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, date ORDER BY t) + (count(*) OVER (PARTITION BY factor, date, t) - 1) / 2.0 AS b FROM l WHERE v IS NOT NULL AND t IS NOT NULL),
ic AS (SELECT factor, date, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic, count(*) AS n FROM k GROUP BY 1, 2)"""


@query(_RANKS + " SELECT factor, date, round(ic, 6) + 0.0 AS ic, n FROM ic")
def rank_ic_daily(spark, d):
    return research.rank_ic(price_signals(spark, d), list(SIGNALS), "raw_ret_5d").select("factor", "date", r("ic").alias("ic"), "n")


@query(_RANKS + " SELECT factor, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, count(*) AS n_dates, round(avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio, round(avg(ic) / stddev_samp(ic), 5) + 0.0 AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) + 0.0 AS t_stat FROM ic WHERE ic IS NOT NULL GROUP BY 1")
def ic_summary(spark, d):
    daily = research.rank_ic(signals(spark, d), list(SIGNALS), "raw_ret_5d").withColumn("ic", F.when(F.abs("ic") < 1e-12, 0.0).otherwise(F.col("ic")))
    s = research.ic_summary(daily)
    return s.select("factor", r("ic_mean").alias("ic_mean"), F.round("ic_std", 6).alias("ic_std"), "n_dates", F.round("hit_ratio", 6).alias("hit_ratio"), r("icir", 5).alias("icir"), r("t_stat", 4).alias("t_stat"))


@query(SIGNALS_SQL + """, s AS (SELECT date, ticker, return_21d AS v, unnest([1, 2, 5]) AS lag, unnest([lead(raw_ret_5d, 1) OVER w, lead(raw_ret_5d, 2) OVER w, lead(raw_ret_5d, 5) OVER w]) AS t FROM sig WINDOW w AS (PARTITION BY ticker ORDER BY date)),
k AS (SELECT lag, date, rank() OVER (PARTITION BY lag, date ORDER BY v) + (count(*) OVER (PARTITION BY lag, date, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lag, date ORDER BY t) + (count(*) OVER (PARTITION BY lag, date, t) - 1) / 2.0 AS b FROM s WHERE v IS NOT NULL AND t IS NOT NULL),
i AS (SELECT lag, date, CASE WHEN count(*) >= 5 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic FROM k GROUP BY 1, 2) SELECT lag, round(avg(ic), 6) + 0.0 AS ic FROM i GROUP BY 1""")
def ic_decay(spark, d):
    return research.ic_decay(signals(spark, d), "return_21d", "raw_ret_5d", [1, 2, 5]).select("lag", r("ic").alias("ic"))


@query(SIGNALS_SQL + ", l AS (SELECT ticker, date, unnest(['zscore_21d', 'return_21d', 'volatility_21d']) AS factor, unnest([zscore_21d, return_21d, volatility_21d]) AS v FROM sig), b AS (SELECT *, lag(v) OVER (PARTITION BY factor, ticker ORDER BY date) AS p FROM l), e AS (SELECT factor, ticker, corr(v, p) AS r, stddev_samp(v) AS sd FROM b GROUP BY 1, 2) SELECT factor, round(avg(r), 6) + 0.0 AS autocorr, count(*) AS n_tickers FROM e WHERE sd >= 1e-8 AND r IS NOT NULL GROUP BY 1")
def autocorr(spark, d):
    return research.autocorrelation(signals(spark, d), list(SIGNALS)).select("factor", r("autocorr").alias("autocorr"), "n_tickers")


_RK = f"{oracle.rank('zscore_21d')} AS a, {oracle.rank('return_21d')} AS b, {oracle.rank('volatility_21d')} AS c"


@query(SIGNALS_SQL + f", f AS (SELECT * FROM sig WHERE zscore_21d IS NOT NULL AND return_21d IS NOT NULL AND volatility_21d IS NOT NULL), k AS (SELECT date, {_RK} FROM f), dd AS (SELECT date, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM k GROUP BY 1 HAVING count(*) >= 5) SELECT 'zscore_21d' AS a, 'return_21d' AS b, round(avg(ab), 6) + 0.0 AS rho FROM dd UNION ALL SELECT 'zscore_21d', 'volatility_21d', round(avg(ac), 6) + 0.0 FROM dd UNION ALL SELECT 'return_21d', 'volatility_21d', round(avg(bc), 6) + 0.0 FROM dd")
def factor_corr_avg(spark, d):
    return research.factor_correlation(signals(spark, d), list(SIGNALS)).select("a", "b", r("rho").alias("rho"))


@query(SIGNALS_SQL + ", l AS (SELECT unnest(['zscore_21d', 'return_21d', 'volatility_21d']) AS factor, unnest([zscore_21d, return_21d, volatility_21d]) AS v FROM sig) SELECT factor, round(count(v) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (WHERE v = 0) / CAST(count(*) AS DOUBLE), 6) AS zero_share, count(*) - count(v) AS n_null FROM l GROUP BY 1")
def coverage(spark, d):
    return research.coverage(signals(spark, d), list(SIGNALS)).select("factor", F.round("coverage", 6).alias("coverage"), F.round("zero_share", 6).alias("zero_share"), "n_null")


def _psi_sql(edges: str) -> str:
    return f"""WITH {oracle.BARS}, a AS (SELECT volume AS x FROM bars WHERE date < DATE '1998-01-01'), b AS (SELECT volume AS x FROM bars WHERE date >= DATE '1998-01-01'), g AS (SELECT {edges} AS e FROM a),
u AS (SELECT x, 1 AS old FROM a UNION ALL SELECT x, 0 FROM b), h AS (SELECT len(list_filter(e[2:len(e) - 1], lambda v: v <= x)) AS k, CAST(sum(old) AS DOUBLE) AS p, CAST(sum(1 - old) AS DOUBLE) AS q FROM u, g GROUP BY 1),
s AS (SELECT greatest(p / sum(p) OVER (), 0.0001) AS p, greatest(q / sum(q) OVER (), 0.0001) AS q FROM h) SELECT round(sum((q - p) * ln(q / p)), 6) + 0.0 AS psi FROM s"""


def _psi(kind: str):
    def run(spark, d):
        b = bars(spark, d)
        return research.psi(b.where("date < date'1998-01-01'"), b.where("date >= date'1998-01-01'"), "volume", kind=kind).select(r("psi").alias("psi"))

    return run


QUERIES |= {"psi_quantiles": _psi("quantiles"), "psi_bins": _psi("bins")}
ORACLES |= {"psi_quantiles": _psi_sql("list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))"), "psi_bins": _psi_sql("list_transform(range(11), lambda i: min(x) + (max(x) - min(x)) * i / 10)")}


@query(SIGNALS_SQL + """, p AS (SELECT date, avg(return_21d) AS m, avg((return_21d - raw_ret_5d) ** 2) AS e FROM sig WHERE return_21d IS NOT NULL AND raw_ret_5d IS NOT NULL GROUP BY 1),
q AS (SELECT date, avg(m) OVER n AS nm, avg(m) OVER o AS om, stddev_samp(m) OVER o AS os, avg(e) OVER n AS ne, avg(e) OVER o AS oe, count(m) OVER o AS k FROM p WINDOW n AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), o AS (ORDER BY date ROWS BETWEEN 41 PRECEDING AND 21 PRECEDING))
SELECT date, round(abs((nm - om) / nullif(os + 1e-9, 0)), 5) AS z, abs((nm - om) / nullif(os + 1e-9, 0)) > 2 AS mean_drift, ne > oe * 1.5 AS error_drift FROM q WHERE k >= 21""")
def drift_two_window(spark, d):
    s = signals(spark, d).where("return_21d is not null and raw_ret_5d is not null")
    daily = s.groupBy("date").agg(F.avg("return_21d").alias("pred_mean"), F.avg(F.pow(F.col("return_21d") - F.col("raw_ret_5d"), F.lit(2.0))).alias("mse"))
    return research.drift(daily).select("date", F.round("z", 5).alias("z"), "mean_drift", "error_drift")


@query(f"WITH {oracle.PANEL}, x AS (SELECT ticker, close / lag(close) OVER w - 1 AS a, sp500_close / nullif(lag(sp500_close) OVER w, 0) - 1 AS b FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)), y AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL) SELECT ticker, round(covar_pop(a, b) / nullif(var_pop(b), 0), 5) + 0.0 AS beta, round(avg(a) - covar_pop(a, b) / nullif(var_pop(b), 0) * avg(b), 5) + 0.0 AS alpha, round(corr(a, b), 6) + 0.0 AS rho, round(CASE WHEN count(*) > 2 THEN sqrt(greatest(var_pop(a) - covar_pop(a, b) ** 2 / nullif(var_pop(b), 0), 0) / nullif(var_pop(b), 0) / (count(*) - 2)) END, 5) AS std_err, count(*) AS n FROM y GROUP BY 1")
def ols_alpha_beta(spark, d):
    y = panel(spark, d).select("ticker", (div("close", lag("close")) - 1).alias("a"), (div("sp500_close", lag("sp500_close")) - 1).alias("b")).where("a is not null and b is not null")
    beta = div(F.covar_pop("a", "b"), F.var_pop("b"))
    rest = F.greatest(F.var_pop("a") - beta * F.covar_pop("a", "b"), F.lit(0.0))
    error = F.when(F.count(F.lit(1)) > 2, F.sqrt(div(div(rest, F.var_pop("b")), F.count(F.lit(1)) - 2)))
    return y.groupBy("ticker").agg(r(beta, 5).alias("beta"), r(F.avg("a") - beta * F.avg("b"), 5).alias("alpha"), r(research.safe_corr("a", "b")).alias("rho"), F.round(error, 5).alias("std_err"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {oracle.BARS}, x AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS a FROM bars) SELECT ticker, CAST(year(date) AS BIGINT) AS year, round(product(1 + a) - 1, 5) + 0.0 AS compounded, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY 1, 2")
def yearly_compound(spark, d):
    x = bars(spark, d).select("ticker", "date", (div("close", lag("close")) - 1).alias("a")).where("a is not null")
    return x.groupBy("ticker", F.year("date").cast("bigint").alias("year")).agg(r(F.product(1 + F.col("a")) - 1, 5).alias("compounded"), F.count(F.lit(1)).alias("n"))


_MONTHS = ", ".join(f"round(sum(x) FILTER (WHERE month(date) = {m}), 4) + 0.0 AS m{m}" for m in range(1, 13))


@query(f"WITH {oracle.BARS}, b AS (SELECT date, avg(a) AS x FROM (SELECT date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS a FROM bars) GROUP BY 1) SELECT CAST(year(date) AS BIGINT) AS year, {_MONTHS} FROM b GROUP BY 1")
def monthly_heatmap_pivot(spark, d):
    b = bars(spark, d).select("date", F.ln(div("close", lag("close"))).alias("a")).groupBy("date").agg(F.avg("a").alias("x"))
    p = b.withColumn("month", F.month("date")).groupBy(F.year("date").cast("bigint").alias("year")).pivot("month", list(range(1, 13))).agg(F.sum("x"))
    return p.select("year", *(r(str(m), 4).alias(f"m{m}") for m in range(1, 13)))


@query(f"""WITH {oracle.BARS}, x AS (SELECT ticker, date, close, close / lag(close) OVER w - 1 AS a, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
s AS (SELECT ticker, first(close ORDER BY date) AS v0, last(close ORDER BY date) AS v1, max(date) - min(date) AS span, count(*) AS n_days, stddev_pop(a) AS sd, avg(a - 0.035 / 252) AS ex, stddev_pop(CASE WHEN a < 0.035 / 252 THEN a END) AS bs, min(dd) AS dd, avg(CASE WHEN a IS NOT NULL THEN CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END END) AS hr FROM x GROUP BY 1)
SELECT ticker, round(v1 / v0 - 1, 5) + 0.0 AS total_return, round(power(v1 / v0, 1 / (span / 365.25)) - 1, 5) + 0.0 AS cagr, round(sd * sqrt(252.0), 4) AS ann_vol, round(ex / sd * sqrt(252.0), 4) + 0.0 AS sharpe, round(ex * 252 / (bs * sqrt(252.0)), 4) + 0.0 AS sortino, round(-dd, 6) + 0.0 AS max_drawdown, round(hr, 6) AS hit_rate, n_days FROM s""")
def performance_metrics(spark, d):
    p = research.performance(bars(spark, d), "close")
    return p.select("ticker", r("total_return", 5).alias("total_return"), r("cagr", 5).alias("cagr"), r("ann_vol", 4).alias("ann_vol"), r("sharpe", 4).alias("sharpe"), r("sortino", 4).alias("sortino"), r("max_drawdown").alias("max_drawdown"), r("hit_rate").alias("hit_rate"), "n_days")


# ---- portfolio
_TOP = SIGNALS_SQL + ", top AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY return_21d DESC, ticker) AS place FROM sig WHERE return_21d IS NOT NULL QUALIFY place <= 5)"
_EQ = _TOP + ", w1 AS (SELECT *, least(1.0 / count(*) OVER (PARTITION BY date), 0.1) AS w0 FROM top), eq AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY date) AS weight FROM w1)"


@query(_EQ + " SELECT date, ticker, round(weight, 6) AS weight FROM eq")
def equal_weight_topn(spark, d):
    return pf.equal_weights(signals(spark, d), "return_21d", 5).select("date", "ticker", F.round("weight", 6).alias("weight"))


@query(SIGNALS_SQL + ", i AS (SELECT date, ticker, 1.0 / greatest(volatility_21d, 1e-4) AS w FROM sig WHERE volatility_21d IS NOT NULL) SELECT date, ticker, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM i")
def inverse_vol(spark, d):
    return pf.inverse_volatility(signals(spark, d), "volatility_21d").select("date", "ticker", F.round("weight", 6).alias("weight"))


_SECT = "CASE WHEN sum(w) OVER (PARTITION BY date, sector) > 0.3 THEN w * 0.3 / sum(w) OVER (PARTITION BY date, sector) ELSE w END"


@query(_EQ + f""", a AS (SELECT date, ticker, sector, volatility_21d AS v, CASE WHEN volume * close > 0 THEN least(least(weight, 0.15), volume * close * 0.1 / 1000000) ELSE 0.0 END AS w FROM eq),
b AS (SELECT * EXCLUDE (w), {_SECT} AS w FROM a), c AS (SELECT * EXCLUDE (w), CASE WHEN pv > 0.2 THEN w * 0.2 / pv ELSE w END AS w FROM (SELECT *, avg(v) OVER (PARTITION BY date) AS pv FROM b)),
e AS (SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY date) > 1.000001 THEN w / sum(w) OVER (PARTITION BY date) ELSE w END AS w FROM c), f AS (SELECT date, ticker, sector, {_SECT} AS w FROM e) SELECT date, ticker, sector, round(w, 7) AS weight FROM f WHERE w >= 0.001""")
def risk_constraints_chain(spark, d):
    s = signals(spark, d)
    w = pf.equal_weights(s, "return_21d", 5).join(s.select("date", "ticker", "sector", "close", "volume", "volatility_21d"), ["date", "ticker"])
    rows = w.withColumns({"adv": F.col("volume"), "price": F.col("close"), "portfolio_vol": F.avg("volatility_21d").over(by_day())})
    return pf.risk_limits(rows, 1e6, cap=0.15).select("date", "ticker", "sector", F.round("weight", 7).alias("weight"))


@query(_EQ + " SELECT date, round(sum(weight * weight), 6) AS hhi, round(1 / sum(weight * weight), 4) AS effective_n FROM eq GROUP BY 1")
def hhi(spark, d):
    c = pf.concentration(pf.equal_weights(signals(spark, d), "return_21d", 5))
    return c.select("date", F.round("hhi", 6).alias("hhi"), F.round("effective_n", 4).alias("effective_n"))


_IMPACT = "abs(s) / volume"


@query(f"""WITH {oracle.BARS}, t AS (SELECT date, ticker, volume, close, (CAST(ticker AS DOUBLE) * 7 + day(date)) / 10 - 20 AS s FROM bars)
SELECT date, ticker, round(CASE WHEN s = 0 THEN 0.0 ELSE 0.1 * ({_IMPACT}) * 1.5 * CASE WHEN s < 0 THEN 1.1 ELSE 1.0 END + 0.015 * power({_IMPACT}, 0.6) * 1.5 * CASE WHEN {_IMPACT} > 0.1 THEN 1 + power({_IMPACT} * 10, 2) ELSE 1.0 END END, 6) AS impact,
round(CASE WHEN s = 0 THEN 0.0 ELSE 0.1 * sqrt({_IMPACT}) END, 6) AS simple, round(abs(s) * close * 0.0015 + abs(s) * close * least({_IMPACT}, 0.02) * 0.0002, 4) AS cost FROM t""")
def market_impact(spark, d):
    t = bars(spark, d).withColumn("s", (F.col("ticker").cast("double") * 7 + F.day("date")) / 10 - 20)
    s, v = F.col("s"), F.col("volume")
    return t.select("date", "ticker", F.round(pf.market_impact(s, v, F.lit(0.03), s < 0), 6).alias("impact"), F.round(pf.square_root_impact(s, v), 6).alias("simple"), F.round(pf.execution_cost(s, F.col("close"), v), 4).alias("cost"))


@query(f"WITH {oracle.BARS}, t AS (SELECT date, ticker, volume, 0.0015 / (0.015 * 0.02 / 0.02) AS q FROM bars) SELECT date, ticker, CAST(floor(volume * least(power(q, 1 / 0.6), 1.0)) AS BIGINT) AS shares, CAST(floor(volume * 0.0225) AS BIGINT) AS root_shares FROM t")
def impact_capacity(spark, d):
    return bars(spark, d).select("date", "ticker", pf.capacity(15.0, F.col("volume"), F.lit(0.02)).alias("shares"), pf.square_root_capacity(150.0, F.col("volume")).alias("root_shares"))


@query(_EQ + ", p AS (SELECT sector, weight * pnl_return AS pnl FROM eq WHERE pnl_return IS NOT NULL) SELECT sector, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_ratio, round(sum(pnl) FILTER (WHERE pnl > 0), 6) AS won, round(sum(pnl) FILTER (WHERE pnl < 0), 6) AS lost FROM p GROUP BY 1")
def pnl_attribution(spark, d):
    s = signals(spark, d)
    p = pf.equal_weights(s, "return_21d", 5).join(s.select("date", "ticker", "sector", "pnl_return"), ["date", "ticker"]).where("pnl_return is not null").withColumn("pnl", F.col("weight") * F.col("pnl_return"))
    return p.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pnl") > 0).cast("double")), 6).alias("hit_ratio"), F.round(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), 6).alias("won"), F.round(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), 6).alias("lost")
    )


@query(_EQ + ", o AS (SELECT date, ticker, CAST(floor(weight * 1000000 / close) AS BIGINT) AS shares, close AS price, weight FROM eq WHERE weight >= 0.0001 AND close > 0) SELECT date, ticker, shares, price, round(shares * price, 2) AS value, CASE WHEN weight > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM o")
def generate_orders(spark, d):
    s = signals(spark, d)
    o = pf.equal_weights(s, "return_21d", 5).join(s.select("date", "ticker", "close"), ["date", "ticker"]).where("weight >= 0.0001 and close > 0")
    shares = F.floor(F.col("weight") * 1e6 / F.col("close")).cast("bigint")
    return o.select("date", "ticker", shares.alias("shares"), F.col("close").alias("price"), F.round(shares * F.col("close"), 2).alias("value"), F.when(F.col("weight") > 0, "BUY").otherwise("SELL").alias("side"))


HISTORY, NAMES = 252, 25


def _candidates(spark, d, n: int = NAMES, days: int = HISTORY) -> DataFrame:
    """The day's top candidates on the first day of each month, with their past returns; names with a gap in these are left out.

    The day's names are chosen first and stored: n a month, however many tickers there are. Ranks are made of first days
    only, and only chosen names' line items are read again, for their history and market cap.
    """
    placed = lambda b: b.withColumn("ret", div("close", lag("close")) - 1).withColumn("i", F.row_number().over(by_ticker()))
    s = placed(price_signals(spark, d)).withColumn("known", F.count("ret").over(by_ticker().rowsBetween(-days, -1)))
    first = s.join(F.broadcast(pf.rebalance_days(bar_days(spark, d), "monthly")), "date", "left_semi")
    ranked = first.withColumn("score", pct_rank("return_21d")).where(F.col("known") == days)
    top = shared_table(xs.top_n(ranked, "score", n).select("date", "ticker", "score", "i"), "candidates")
    chosen = F.broadcast(top.select("ticker").distinct())
    own = placed(bars(spark, d).join(chosen, "ticker", "left_semi")).select("ticker", F.col("i").alias("j"), "ret")
    top = asof_join(top, statements(spark, d).join(chosen, "ticker", "left_semi"), "ticker", "date", ["market_cap"])
    past = top.withColumn("j", F.explode(F.sequence(F.col("i") - days, F.col("i") - 1))).join(own, ["ticker", "j"])
    returns = past.groupBy("date", "ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "ret"))), lambda x: x["ret"]).alias("returns"))
    return top.drop("i").join(returns, ["date", "ticker"])


def _allocation(method: str):
    def run(spark, d):
        return pf.allocate(_candidates(spark, d), method, cap=0.4).select("date", "ticker", F.round("weight", 6).alias("weight"))

    return run


QUERIES |= {f"allocate_{m}": _allocation(m) for m in pf.METHODS}
ORACLES["allocate_top_n"] = SIGNALS_SQL + f""", a AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret, {oracle.rank("return_21d")} AS score FROM sig),
b AS (SELECT *, count(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING) AS known FROM a), f AS (SELECT min(date) AS date FROM sig GROUP BY date_trunc('month', date)),
t AS (SELECT b.date, b.ticker, row_number() OVER (PARTITION BY b.date ORDER BY score DESC, ticker) AS place FROM b JOIN f ON b.date = f.date WHERE known = {HISTORY} AND score IS NOT NULL)
SELECT date, ticker, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM t WHERE place <= {NAMES}"""


def _books(spark, d) -> DataFrame:
    """The strategies' days; bars with signals and the weights of five names a day are computed once and stored."""
    s = shared_table(price_signals(spark, d).select("date", "ticker", "open", "close", "volume", *SIGNALS), "signals")
    picks = [pf.equal_weights(s, x, 5).select(F.lit(x).alias("strategy"), "date", "ticker", "weight") for x in SIGNALS]
    weights = shared_table(picks[0].union(picks[1]).union(picks[2]), "weights")
    return pf.signal_days(s.select("date", "ticker", "open", "close", "volume"), weights)


@query()
def backtest_run(spark, d):
    """Daily ledger of three strategies."""
    return pf.backtest(_books(spark, d))


@query()
def backtest_trades(spark, d):
    """All trades of three strategies whose positions are capped at a quarter."""
    return pf.backtest_trades(pf.backtest_events(_books(spark, d), position_cap=0.25))


@query()
def backtest_positions(spark, d):
    """What three strategies hold at the end."""
    return pf.backtest_positions(pf.backtest_events(_books(spark, d)))


@query(f"""WITH {oracle.BARS}, m AS MATERIALIZED (SELECT date, avg(a) AS x FROM (SELECT date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS a FROM bars) GROUP BY 1), y AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM m WHERE x IS NOT NULL),
k AS (SELECT s, CAST('0x' || substr(md5(concat_ws('|', CAST(s AS VARCHAR), CAST(y.i AS VARCHAR), '0')), 1, 10) AS BIGINT) % n AS i FROM y, range(200) AS r(s)), e AS (SELECT s, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0) AS sharpe FROM k JOIN y ON k.i = y.i GROUP BY 1)
SELECT round(quantile_cont(sharpe, 0.025), 4) + 0.0 AS low, round(quantile_cont(sharpe, 0.5), 4) + 0.0 AS middle, round(quantile_cont(sharpe, 0.975), 4) + 0.0 AS high FROM e""")
def bootstrap_sharpe(spark, d):
    """Percentile interval of a yearly Sharpe ratio over 200 resamples of the daily market return, drawn by hash."""
    day = bars(spark, d).select("date", (div("close", lag("close")) - 1).alias("a")).groupBy("date").agg(F.avg("a").alias("x")).where("x is not null")
    day = day.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    n = day.count()
    draws = spark.range(200).withColumnRenamed("id", "s").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("s", (draw("s", "k") % n).cast("int").alias("i"))
    each = draws.join(F.broadcast(day.select("i", "x")), "i").groupBy("s").agg((div(F.avg("x"), F.stddev_samp("x")) * 252**0.5).alias("sharpe"))
    return each.agg(*(r(F.percentile("sharpe", q), 4).alias(name) for name, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))))


# ---- sets and breadth


@query(f"WITH {oracle.BARS}, a AS (SELECT date, ticker, close, 1 AS fold FROM bars WHERE date < DATE '1999-01-01' UNION ALL SELECT date, ticker, close + 1, 2 FROM bars WHERE date >= DATE '1998-01-01') SELECT date, ticker, close, fold FROM a QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY fold DESC) = 1")
def union_dedupe(spark, d):
    b = bars(spark, d).select("date", "ticker", "close")
    folds = b.where("date < date'1999-01-01'").withColumn("fold", F.lit(1)).unionByName(b.where("date >= date'1998-01-01'").select("date", "ticker", (F.col("close") + 1).alias("close"), F.lit(2).alias("fold")))
    return shaping.keep_one(folds, ["date", "ticker"], [F.desc("fold")])


@query(f"WITH {oracle.BARS}, {oracle.MACRO} SELECT date FROM bars INTERSECT SELECT date FROM macro")
def intersect_dates(spark, d):
    return bars(spark, d).select("date").intersect(macro(spark, d).select("date"))


@query("SELECT s_suppkey AS ticker FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.08")
def except_tickers(spark, d):
    sold = read(spark, d, "lineitem", ["l_suppkey", "l_quantity", "l_discount"]).where("l_quantity >= 49 and l_discount > 0.08")
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker")).subtract(sold.select("l_suppkey"))


@query(f"WITH {oracle.BARS}, {oracle.SECTORS} SELECT sector, CAST(year(date) AS BIGINT) AS year, count(DISTINCT ticker) AS n_tickers, count(*) AS n FROM bars JOIN sectors USING (ticker) GROUP BY ROLLUP (sector, 2)")
def rollup_counts(spark, d):
    b = bars(spark, d).join(sectors(spark, d), "ticker").withColumn("year", F.year("date").cast("bigint"))
    return b.rollup("sector", "year").agg(F.count_distinct("ticker").alias("n_tickers"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_quantities(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
