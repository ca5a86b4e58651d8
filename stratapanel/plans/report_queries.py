"""Registered queries of report figures, significance, bounded weights and refresh checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.functions.expr import div, lag
from stratapanel.operators import cross_section as xs
from stratapanel.operators import execution, reports, research
from stratapanel.operators import portfolio as pf
from stratapanel.plans import oracle
from stratapanel.plans.panel_queries import _EQ, SIGNALS, SIGNALS_SQL, price_signals, r, signals
from stratapanel.sources.files import adjusted_history
from stratapanel.sources.shared import shared_table
from stratapanel.sources.tables import bars, macro, read, statements

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ALL3 = "unnest(['zscore_21d', 'return_21d', 'volatility_21d']) AS factor, unnest([zscore_21d, return_21d, volatility_21d]) AS v"


@query(f"""WITH {oracle.BARS}, x AS (SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS a FROM bars),
s AS (SELECT ticker, stddev_samp(a) AS sd, avg(a) AS m, avg(a - 0.02 / 252) AS ex, sqrt(avg(power(a - 0.02 / 252, 2)) FILTER (WHERE a - 0.02 / 252 < 0)) AS loss, avg(a - 0.035 / 252) AS ab, sqrt(avg(CASE WHEN a IS NOT NULL THEN power(least(a - 0.035 / 252, 0.0), 2) END)) AS down,
  first(close ORDER BY date) AS v0, last(close ORDER BY date) AS v1, max(date) - min(date) AS span FROM x GROUP BY 1)
SELECT ticker, round(CASE WHEN coalesce(sd < 1e-9, true) THEN 0.0 ELSE ex / sd * sqrt(252.0) END, 4) + 0.0 AS sharpe, round(CASE WHEN coalesce(loss * sqrt(252.0) < 1e-9, true) THEN CAST('Infinity' AS DOUBLE) ELSE ex * 252 / (loss * sqrt(252.0)) END, 4) + 0.0 AS sortino,
round(CASE WHEN span > 0 THEN power(v1 / v0, 365.0 / span) - 1 ELSE 0.0 END, 5) + 0.0 AS report_cagr, round(CASE WHEN coalesce(sd < 1e-9, true) THEN 0.0 ELSE m / sd * sqrt(252.0) END, 4) + 0.0 AS report_sharpe, round(CASE WHEN coalesce(down < 1e-9, true) THEN 0.0 ELSE ab / down * sqrt(252.0) END, 4) + 0.0 AS report_sortino FROM s""")
def return_figures(spark, d):
    f = reports.return_figures(bars(spark, d))
    return f.select("ticker", r("sharpe", 4).alias("sharpe"), r("sortino", 4).alias("sortino"), r("report_cagr", 5).alias("report_cagr"), r("report_sharpe", 4).alias("report_sharpe"), r("report_sortino", 4).alias("report_sortino"))


@query(f"""WITH {oracle.BARS}, a AS (SELECT ticker, date, close / max(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM bars), b AS (SELECT *, dd < -0.001 AS under FROM a),
c AS (SELECT *, CASE WHEN under IS DISTINCT FROM lag(under) OVER (PARTITION BY ticker ORDER BY date) THEN 1 ELSE 0 END AS t FROM b), e AS (SELECT *, sum(t) OVER (PARTITION BY ticker ORDER BY date) AS run FROM c),
g AS (SELECT ticker, min(dd) AS depth, min(date) AS start, first(date ORDER BY dd, date) AS valley, max(date) AS l, last(nx ORDER BY date) AS recovery FROM e WHERE under GROUP BY ticker, run)
SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY depth, start) AS place, round(depth, 6) AS depth, start, valley, recovery, CAST(coalesce(recovery, l) - start AS BIGINT) AS days FROM g QUALIFY place <= 3""")
def top_drawdowns(spark, d):
    t = reports.top_drawdowns(bars(spark, d))
    return t.select("ticker", F.col("place").cast("bigint").alias("place"), F.round("depth", 6).alias("depth"), "start", "valley", "recovery", F.col("days").cast("bigint").alias("days"))


@query(SIGNALS_SQL + """, kn AS (SELECT date, ticker, return_21d AS s, pnl_return AS p FROM sig WHERE return_21d IS NOT NULL AND pnl_return IS NOT NULL), dy AS (SELECT date, avg(p) AS b, row_number() OVER (ORDER BY date) - 1 AS i FROM kn GROUP BY 1),
ro AS (SELECT kn.*, i, i // 5 AS k FROM kn JOIN dy ON kn.date = dy.date), pk AS (SELECT k, ticker FROM ro WHERE i % 5 = 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) <= 20), hd AS (SELECT date, avg(p) AS raw FROM ro JOIN pk USING (k, ticker) GROUP BY 1),
sz AS (SELECT k + 1 AS k, count(*) AS n FROM pk GROUP BY 1), kp AS (SELECT a.k, count(*) AS n FROM pk a JOIN pk b ON a.k = b.k + 1 AND a.ticker = b.ticker GROUP BY 1),
al AS (SELECT dy.date, i, b, coalesce(raw, 0.0) AS raw, CASE WHEN i % 5 = 0 THEN coalesce(1 - coalesce(kp.n, 0) / CAST(sz.n AS DOUBLE), 0) ELSE 0 END * 0.002 AS cost FROM dy LEFT JOIN hd ON dy.date = hd.date LEFT JOIN sz ON sz.k = i // 5 LEFT JOIN kp ON kp.k = i // 5),
lv AS (SELECT *, CASE WHEN count(raw) OVER w >= 20 AND stddev_pop(raw) OVER w > 0 THEN least(1.0, 0.15 / (stddev_pop(raw) OVER w * sqrt(252.0))) ELSE 1.0 END AS lev FROM al WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT date, round(raw, 6) + 0.0 AS raw_return, round(lev, 6) AS leverage, round(cost, 6) AS cost, round(raw * lev - cost, 6) + 0.0 AS managed_return, round(b, 6) + 0.0 AS benchmark_return FROM lv""")
def performance_tracker(spark, d):
    t = reports.tracker(signals(spark, d).select("date", "ticker", F.col("return_21d").alias("score"), "pnl_return"))
    return t.select("date", *(r(c).alias(c) for c in t.columns if c != "date"))


@query(SIGNALS_SQL + """, m AS (SELECT date, avg(pnl_return) FILTER (WHERE return_21d > 0) AS x, avg(pnl_return) AS y FROM sig GROUP BY 1), k AS (SELECT * FROM m WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT date, CASE WHEN count(*) OVER w >= 126 THEN round(stddev_samp(x) OVER w * sqrt(252.0), 5) END AS vol, CASE WHEN count(*) OVER w >= 126 THEN round(avg(x) OVER w * 252 / (stddev_samp(x) OVER w * sqrt(252.0) + 1e-6), 5) + 0.0 END AS sharpe, CASE WHEN count(*) OVER w >= 126 THEN round(covar_samp(x, y) OVER w / (var_samp(y) OVER w + 1e-6), 5) + 0.0 END AS beta
FROM k WINDOW w AS (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)""")
def rolling_risk(spark, d):
    daily = signals(spark, d).groupBy("date").agg(F.avg(F.when(F.col("return_21d") > 0, F.col("pnl_return"))).alias("x"), F.avg("pnl_return").alias("y"))
    return reports.rolling_risk(daily, "x", "y").select("date", F.round("vol", 5).alias("vol"), r("sharpe", 5).alias("sharpe"), r("beta", 5).alias("beta"))


@query(f"""WITH {oracle.BARS}, {oracle.MACRO}, j AS (SELECT b.ticker, b.date, b.close, m.sp500_close AS z FROM bars b LEFT JOIN macro m ON b.date = m.date), k AS (SELECT *, first_value(z IGNORE NULLS) OVER w AS s, first_value(close) OVER w AS c FROM j WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT ticker, date, close, CASE WHEN s > 0 THEN round(z / s * c, 4) END AS rebased FROM k""")
def benchmark_rebased(spark, d):
    m = macro(spark, d).select("date", F.col("sp500_close").alias("benchmark"))
    return reports.rebased(bars(spark, d).select("ticker", "date", "close"), m).select("ticker", "date", "close", F.round("rebased", 4).alias("rebased"))


_SIDE = _EQ + ", o AS (SELECT date, CASE WHEN zscore_21d > 0 THEN 'LONG' ELSE 'SHORT' END AS side, weight * 1000000 * CASE WHEN zscore_21d > 0 THEN 1 ELSE -1 END AS value, weight FROM eq)"


@query(_SIDE + ", x AS (SELECT date, coalesce(sum(abs(value)) FILTER (WHERE side = 'LONG'), 0) AS l, coalesce(sum(abs(value)) FILTER (WHERE side = 'SHORT'), 0) AS s, sum(weight * weight) / (sum(weight) * sum(weight)) AS h, count(*) AS n FROM o GROUP BY 1) SELECT date, round(l, 2) AS long_value, round(s, 2) AS short_value, round(l + s, 2) AS gross, round(l - s, 2) + 0.0 AS net, round(h, 6) AS hhi, h > 0.10 AS concentrated, n FROM x")
def order_exposure(spark, d):
    s = signals(spark, d)
    up = F.col("zscore_21d") > 0
    o = pf.equal_weights(s, "return_21d", 5).join(s.select("date", "ticker", "zscore_21d"), ["date", "ticker"])
    e = reports.exposure(o.select("date", F.when(up, "LONG").otherwise("SHORT").alias("side"), (F.col("weight") * 1e6 * F.when(up, 1).otherwise(-1)).alias("value"), "weight"))
    return e.select("date", *(r(c, 2).alias(c) for c in ("long_value", "short_value", "gross", "net")), F.round("hhi", 6).alias("hhi"), "concentrated", "n")


_OLD = "CAST(len(list_filter(generate_series({0}, DATE '1999-06-30', INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - CASE WHEN isodow({0}) < 6 THEN 1 ELSE 0 END AS INTEGER)"


@query(f"""WITH {oracle.BARS}, {oracle.MACRO}, {oracle.STATEMENTS}, u AS (SELECT 'prices' AS source, max(date) AS l FROM bars WHERE date <= DATE '1999-06-25' UNION ALL SELECT 'macro', max(date) FROM macro WHERE date <= DATE '1999-06-25' UNION ALL SELECT 'fundamentals', max(date) FROM statements WHERE date <= DATE '1999-06-25')
SELECT source, l AS last_day, {_OLD.format("l")} AS business_days, {_OLD.format("l")} > 5 AS is_stale FROM u""")
def data_freshness(spark, d):
    """Each table's last day before a landing-zone cut, in business days before the day of the report."""
    tables = {"prices": bars(spark, d), "macro": macro(spark, d), "fundamentals": statements(spark, d)}
    return reports.freshness({k: t.where("date <= date'1999-06-25'") for k, t in tables.items()}, "1999-06-30")


@query(f"""WITH {oracle.STATEMENTS}, g AS (SELECT ticker, DATE '1998-06-01' - max(date) FILTER (WHERE date <= DATE '1998-06-01') AS age, min(date) AS f, max(date) FILTER (WHERE eps_estimate IS NOT NULL) AS ahead, min(date) FILTER (WHERE eps_estimate IS NOT NULL) AS since FROM statements GROUP BY 1)
SELECT ticker, CAST(age AS INTEGER) AS age_days, coalesce(age >= 90, true) AS is_stale, f > DATE '1998-06-01' - 1095 AS is_incomplete, coalesce(ahead < DATE '1998-06-01' OR DATE '1998-06-01' - since < 365, true) AS earnings_due FROM g""")
def refresh_due(spark, d):
    return reports.refresh_due(statements(spark, d), "1998-06-01")


@query(SIGNALS_SQL + " SELECT date, ticker, round(return_21d, 6) + 0.0 AS return_21d FROM sig WHERE date = (SELECT max(date) FROM sig)")
def last_day_signals(spark, d):
    return reports.on_last_day(signals(spark, d)).select("date", "ticker", r("return_21d").alias("return_21d"))


@query(f"WITH {oracle.BARS}, p AS (SELECT date_trunc('month', date) AS m, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS a FROM bars), g AS (SELECT m, ticker, product(1 + a) - 1 AS g FROM p WHERE a IS NOT NULL GROUP BY 1, 2), w AS (SELECT m, ticker, count(*) / sum(count(*)) OVER (PARTITION BY m) AS w FROM p GROUP BY 1, 2) SELECT CAST(g.m AS DATE) AS period, round(sum(w * g), 5) + 0.0 AS held_return FROM g JOIN w ON g.m = w.m AND g.ticker = w.ticker GROUP BY 1")
def held_returns(spark, d):
    """A month's book, weighted by the days of each name, held over the month."""
    from pyspark.sql import Window

    p = bars(spark, d).select(F.trunc("date", "month").alias("period"), "ticker", (div("close", lag("close")) - 1).alias("r"))
    w = p.groupBy("period", "ticker").agg(F.count(F.lit(1)).alias("n")).select("period", "ticker", div("n", F.sum("n").over(Window.partitionBy("period"))).alias("weight"))
    return reports.held_returns(w, p).select("period", r("held_return", 5).alias("held_return"))


@query(SIGNALS_SQL + ", e AS (SELECT date, ticker, CASE WHEN raw_ret_5d * zscore_21d < 0 THEN 2.0 ELSE 1.0 END AS w, tanh(raw_ret_5d - zscore_21d) AS t FROM sig WHERE raw_ret_5d IS NOT NULL AND zscore_21d IS NOT NULL) SELECT date, ticker, round(-w * t, 6) + 0.0 AS gradient, round(greatest(w * (1 - t * t), 1e-3), 6) AS curvature FROM e")
def signed_error(spark, d):
    g, h = reports.signed_error(F.col("raw_ret_5d"), F.col("zscore_21d"))
    return signals(spark, d).where("raw_ret_5d is not null and zscore_21d is not null").select("date", "ticker", r(g).alias("gradient"), F.round(h, 6).alias("curvature"))


@query(f"WITH {oracle.BARS} SELECT ticker, '$' || format('{{:,.0f}}', CAST(sum(CAST(close * volume AS DECIMAL(18, 2))) AS DOUBLE)) AS traded FROM bars GROUP BY 1")
def formatted_value(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.sum((F.col("close") * F.col("volume")).cast("decimal(18,2)")).alias("v")).select("ticker", reports.dollars(F.col("v")).alias("traded"))


@query(SIGNALS_SQL + f", l AS (SELECT {_ALL3} FROM sig), s AS (SELECT factor, 1 - count(v) / CAST(count(*) AS DOUBLE) AS m, stddev_samp(v) AS sd FROM l GROUP BY 1) SELECT factor, round(m, 6) + 0.0 AS missing, round(sd, 6) AS sd, CASE WHEN m > 0.5 THEN 'missing' WHEN sd IS NULL OR sd < 1e-8 THEN 'constant' END AS reason FROM s")
def prefilter_factors(spark, d):
    return research.prefilter(signals(spark, d), list(SIGNALS)).select("factor", r("missing").alias("missing"), F.round("sd", 6).alias("sd"), "reason")


@query(SIGNALS_SQL + ", x AS (SELECT close / open - 1 AS a, raw_ret_5d AS b FROM sig WHERE raw_ret_5d IS NOT NULL AND open > 0), s AS (SELECT covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS rho, count(*) AS n FROM x) SELECT round(rho, 6) + 0.0 AS rho, n, n >= 100 AND abs(rho) > 0.3 AS leaks FROM s")
def lookahead_check(spark, d):
    return research.lookahead(signals(spark, d), "raw_ret_5d").select(r("rho").alias("rho"), "n", "leaks")


@query(SIGNALS_SQL + f""", l AS (SELECT date, sector, raw_ret_5d AS t, {_ALL3} FROM sig WHERE raw_ret_5d IS NOT NULL),
k AS (SELECT factor, date, (v - avg(v) OVER g) / (stddev_samp(v) OVER g + 1e-8) AS fz, (t - avg(t) OVER g) / (stddev_samp(t) OVER g + 1e-8) AS tz, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY factor, date ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY factor, date, v) - 1) / 2.0 END AS fr,
  rank() OVER (PARTITION BY factor, date ORDER BY t) + (count(*) OVER (PARTITION BY factor, date, t) - 1) / 2.0 AS tr FROM l WINDOW g AS (PARTITION BY factor, date, sector)),
y AS (SELECT factor, date, count(*) AS n, count(fr) * covar_pop(fr, tr) FILTER (WHERE fr IS NOT NULL) / nullif(sqrt(count(fr) * var_pop(fr) * count(tr) * var_pop(tr)), 0) AS ic, count(fz) * covar_pop(fz, tz) FILTER (WHERE fz IS NOT NULL) / nullif(sqrt(count(fz) * var_pop(fz) * count(tz) * var_pop(tz)), 0) AS sn FROM k GROUP BY 1, 2),
z AS (SELECT factor, sum(ic * n) / sum(n) FILTER (WHERE ic IS NOT NULL) AS m, stddev_samp(ic) + 1e-8 AS sd, avg(CASE WHEN ic > 1e-12 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS h, count(ic) AS nd, CASE WHEN count(sn) >= 3 THEN sum(sn * n) / sum(n) FILTER (WHERE sn IS NOT NULL) / (stddev_samp(sn) + 1e-8) END AS sr FROM y GROUP BY 1)
SELECT factor, round(m, 5) + 0.0 AS ic_mean, round(sd, 5) AS ic_std, round(m / sd, 4) + 0.0 AS icir, round(m / sd * sqrt(nd), 3) + 0.0 AS t_stat, round(h, 3) AS hit_ratio, nd AS n_dates, round(sr, 4) + 0.0 AS sn_icir FROM z WHERE nd >= 3""")
def ic_significance(spark, d):
    s = research.ic_significance(signals(spark, d), list(SIGNALS), "raw_ret_5d")
    return s.select("factor", r("ic_mean", 5).alias("ic_mean"), F.round("ic_std", 5).alias("ic_std"), r("icir", 4).alias("icir"), r("t_stat", 3).alias("t_stat"), F.round("hit_ratio", 3).alias("hit_ratio"), "n_dates", r("sn_icir", 4).alias("sn_icir"))


@query()
def bootstrap_ic(spark, d):
    """Rank correlations in five bounded samples, drawn by hash."""
    rows = shared_table(price_signals(spark, d).select("date", "ticker", *SIGNALS, "raw_ret_5d"), "signals")  # each sample reads them
    return research.bootstrap_ic(rows, list(SIGNALS), "raw_ret_5d")


@query(SIGNALS_SQL + """, a AS (SELECT date, ticker, return_21d AS x, count(return_21d) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY return_21d NULLS LAST, ticker) AS i FROM sig),
b AS (SELECT *, min(x) FILTER (WHERE i > floor(0.05 * n)) OVER (PARTITION BY date) AS lo, max(x) FILTER (WHERE i <= n - floor(0.05 * n)) OVER (PARTITION BY date) AS hi FROM a), c AS (SELECT date, ticker, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS x FROM b)
SELECT date, ticker, round((x - avg(x) OVER (PARTITION BY date)) / (stddev_samp(x) OVER (PARTITION BY date) + 1e-8), 5) + 0.0 AS return_21d FROM c""")
def winsorize_standardize(spark, d):
    w = xs.winsorize_count(signals(spark, d).select("date", "ticker", "return_21d"), "return_21d", 0.05, 0.05)
    return xs.standardize(w, "return_21d").select("date", "ticker", r("return_21d", 5).alias("return_21d"))


@query(SIGNALS_SQL + """, i AS (SELECT date, ticker, 1.0 / greatest(volatility_21d, 1e-4) AS w FROM sig WHERE volatility_21d IS NOT NULL), a AS (SELECT date, ticker, w / sum(w) OVER (PARTITION BY date) AS w FROM i), p AS (SELECT * FROM a QUALIFY w >= 0.01 OR row_number() OVER (PARTITION BY date ORDER BY w DESC, ticker) = 1),
q AS (SELECT date, ticker, w / sum(w) OVER (PARTITION BY date) AS w FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, ticker) - 1 AS b, sum(w) OVER (PARTITION BY date ORDER BY w DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY date) AS n FROM q),
f AS (SELECT *, w * (1 - b * 0.25) / rest > 0.25 + 1e-9 AS u FROM o), g AS (SELECT *, sum(CASE WHEN u THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS m, sum(CASE WHEN NOT u THEN w END) OVER (PARTITION BY date) AS free FROM f)
SELECT date, ticker, round(CASE WHEN n * 0.25 <= 1 THEN 1.0 / n WHEN u THEN 0.25 ELSE w * (1 - m * 0.25) / free END, 6) AS weight FROM g""")
def bounded_weights(spark, d):
    s = signals(spark, d)
    w = pf.inverse_volatility(s, "volatility_21d").join(s.select("date", "ticker", "sector"), ["date", "ticker"])
    return pf.bounded_weights(w).select("date", "ticker", F.round("weight", 6).alias("weight"))


@query(SIGNALS_SQL + " SELECT ticker, arg_max(market_cap, date) AS market_cap FROM sig WHERE market_cap IS NOT NULL GROUP BY 1")
def last_market_cap(spark, d):
    return signals(spark, d).where("market_cap is not null").groupBy("ticker").agg(F.max_by("market_cap", "date").alias("market_cap"))


@query(f"WITH {oracle.BARS}, n AS (SELECT ticker, date, close * CASE WHEN ticker % 10 = 0 THEN 1.5 ELSE 1.0 END AS close FROM bars WHERE date >= DATE '1998-06-01') SELECT b.ticker, max(abs(b.close - n.close)) / avg(b.close) > 0.01 AS rebuild FROM bars b JOIN n ON b.ticker = n.ticker AND b.date = n.date GROUP BY 1")
def adjusted_prices(spark, d):
    """Names whose new closes disagree with the stored ones (a split of every tenth name is put into the new rows)."""
    b = bars(spark, d).select("ticker", "date", "close")
    new = b.where("date >= date'1998-06-01'").withColumn("close", F.col("close") * F.when(F.col("ticker") % 10 == 0, 1.5).otherwise(1.0))
    return adjusted_history(b, new)


_DRAW = "(CAST('0x' || substr(md5(concat_ws('|', CAST(date AS VARCHAR), CAST(ticker AS VARCHAR), '{}')), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0"


@query(f"""WITH {oracle.BARS}, o AS (SELECT date, ticker, close, CAST(trunc(volume / 10) AS BIGINT) AS shares, CASE WHEN ticker % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
CASE WHEN volume <= 0 THEN 'ZERO_VOLUME' WHEN {_DRAW.format(11)} > 0.95 THEN 'PROBABILITY' WHEN CAST(trunc(volume / 10) AS BIGINT) <= 0 OR close <= 0 THEN 'INVALID_INPUTS' END AS failure_reason,
0.0005 + 0.0002 * exp(sqrt(-2 * ln({_DRAW.format(21)})) * cos(2 * pi() * {_DRAW.format(22)}) * 0.02) + 0.0001 AS rate FROM bars)
SELECT date, ticker, side, shares, close, round(greatest(CASE WHEN side = 'buy' THEN close + rate * close ELSE close - rate * close END, 0.01), 6) AS fill_price, round(shares * close * 0.001, 6) AS commission_usd, failure_reason IS NULL AS success, failure_reason FROM o WHERE shares > 0""")
def simulated_fills(spark, d):
    """Every bar as an order for a tenth of its volume; fills and slippage are drawn by hash."""
    b = bars(spark, d)
    orders = b.select("date", "ticker", (F.col("volume") / 10).alias("shares"), F.when(F.col("ticker") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(0.0001).alias("impact_rate"))
    done = execution.fills(orders, b.select("date", "ticker", "close", "volume", F.lit(0.02).alias("volatility")), fill=0.95)
    return done.where("shares > 0").select("date", "ticker", "side", "shares", "close", F.round("fill_price", 6).alias("fill_price"), F.round("commission_usd", 6).alias("commission_usd"), "success", "failure_reason")


@query(f"""WITH RECURSIVE {oracle.BARS}, e AS MATERIALIZED (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS seq FROM bars),
x AS MATERIALIZED (SELECT ticker, seq, CASE WHEN seq % 3 = 1 THEN 'buy' WHEN seq % 3 = 2 THEN 'dividend' ELSE 'sell' END AS type, CASE WHEN seq % 3 = 2 THEN 0.5 ELSE close END AS price FROM e),
s AS (SELECT DISTINCT ticker, CAST(0 AS BIGINT) AS seq, '' AS type, CAST(0 AS DOUBLE) AS price, CAST(1000000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS pnl, false AS accepted FROM x
UNION ALL SELECT ticker, seq, type, price, CASE WHEN NOT fine THEN cash WHEN type = 'buy' THEN cash - raw * 1.001 WHEN type = 'sell' THEN cash + net ELSE cash + shares * price END, CASE WHEN NOT fine OR type = 'dividend' THEN shares WHEN type = 'buy' THEN shares + 5 ELSE shares - 5 END,
CASE WHEN fine AND type = 'buy' THEN (shares * cost + raw) / (shares + 5) WHEN fine AND type = 'sell' AND shares - 5 < 1e-9 THEN 0.0 ELSE cost END, CASE WHEN NOT fine OR type = 'buy' THEN 0.0 WHEN type = 'sell' THEN net - 5 * cost ELSE shares * price END, fine
FROM (SELECT x.ticker, x.seq, x.type, x.price, s.cash, s.shares, s.cost, 5 * x.price * 1.0005 AS raw, 5 * x.price * 0.9995 * 0.999 AS net,
  CASE x.type WHEN 'buy' THEN x.price > 0 AND 5 * x.price * 1.0005 * 1.001 <= s.cash + 1e-9 WHEN 'sell' THEN s.shares + 1e-9 >= 5 AND x.price > 0 ELSE s.shares * x.price > 0 END AS fine FROM s JOIN x ON x.ticker = s.ticker AND x.seq = s.seq + 1))
SELECT CAST(ticker AS VARCHAR) AS portfolio, seq, type, round(price, 4) AS price, round(cash, 2) AS cash, round(pnl, 2) + 0.0 AS pnl, accepted FROM s WHERE seq > 0""")
def cash_ledger(spark, d):
    """Each name's buys, dividends and sells through a ledger of its own."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    rows = bars(spark, d).withColumn("seq", i.cast("long"))
    kind = F.when(F.col("seq") % 3 == 1, "buy").when(F.col("seq") % 3 == 2, "dividend").otherwise("sell")
    price = F.when(F.col("seq") % 3 == 2, 0.5).otherwise(F.col("close"))
    entries = rows.select(F.col("ticker").cast("string").alias("portfolio"), "seq", kind.alias("type"), F.col("ticker").cast("string").alias("ticker"), F.lit(5.0).alias("shares"), price.alias("price"))
    return execution.ledger(entries).select("portfolio", "seq", "type", F.round("price", 4).alias("price"), F.round("cash", 2).alias("cash"), r("pnl", 2).alias("pnl"), "accepted")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def event_days(spark, d):
    e = read(spark, d, "events", ["event_type", "ts", "user_id"])
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
