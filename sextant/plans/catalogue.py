"""Every query of the core engine by name, with the SQL it is held against.

The tables stand in for the engine's inputs: monthly order value by nation is a panel of series, order priorities are another, line
shipments after an order are vintages of its month, parts are a tagged corpus, market segments are tickers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.columns import average_rank, pearson, ratio, tidy
from sextant.functions.periods import YEAR, period_end
from sextant.functions.transforms import TRANSFORMS, apply_transform, lag
from sextant.operators import analogues, asof, backtest, cointegration, events, locks, quality, registry, resampling, statistics, strategy, studies, verdicts, vintage, wide
from sextant.operators.asof import asof_join
from sextant.operators.grid import Predictor, build_grid, plan_features
from sextant.operators.kernels import adf, adf_fit, engle_granger, granger, granger_f, johansen, kpss, ols_hac, per_series, stl, strength
from sextant.operators.rollup import apply_release_lag, rollup, rollup_audit
from sextant.sources import files
from sextant.sources.nested import p_value

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "signal_backtest"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(*columns)


def daily(spark, d):
    """Order value by priority and day."""
    o = read(spark, d, "orders", "o_orderpriority", "o_orderdate", "o_totalprice")
    return o.select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"), F.col("o_totalprice").alias("value"))


def panel(spark, d):
    """Order value by nation and month, whole months."""
    o, c = read(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice"), read(spark, d, "customer", "c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).where(F.to_date("o_orderdate") < "2001-08-01")
    return rows.groupBy(F.col("c_nationkey").cast("string").alias("series_id"), F.last_day("o_orderdate").alias("obs_date")).agg(F.sum("o_totalprice").alias("value"))


def monthly(spark, d):
    """Order value by priority and month, whole months."""
    return daily(spark, d).where(F.col("obs_date") < "2001-08-01").groupBy("series_id", F.last_day("obs_date").alias("obs_date")).agg(F.sum("value").alias("value"))


def shipped(spark, d):
    """Shipped value by month."""
    li = read(spark, d, "lineitem", "l_shipdate", "l_extendedprice")
    return li.groupBy(F.last_day("l_shipdate").alias("obs_date")).agg(F.sum("l_extendedprice").alias("value"))


def pairs(spark, d):
    """Months of each priority with the month's shipped value."""
    return monthly(spark, d).withColumnRenamed("value", "p").join(shipped(spark, d).withColumnRenamed("value", "t"), "obs_date")


def vintages(spark, d):
    """Value of a month's orders, as known from shipments month by month."""
    o, li = read(spark, d, "orders", "o_orderkey", "o_orderdate"), read(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice")
    rows = o.join(li, o.o_orderkey == li.l_orderkey).where(F.to_date("l_shipdate") >= F.to_date("o_orderdate"))
    sums = rows.groupBy(F.last_day("o_orderdate").alias("obs_date"), F.last_day("l_shipdate").alias("vintage_date")).agg(F.sum("l_extendedprice").alias("v"))
    w = Window.partitionBy("obs_date").orderBy("vintage_date")
    return sums.select(F.lit("all").alias("series_id"), "obs_date", "vintage_date", F.round(F.sum("v").over(w), 2).alias("value"))


DAILY = "daily AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice AS value FROM orders)"
PANEL = "panel AS (SELECT CAST(c_nationkey AS VARCHAR) AS series_id, last_day(CAST(o_orderdate AS DATE)) AS obs_date, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) < DATE '2001-08-01' GROUP BY 1, 2)"
MONTHLY = f"{DAILY}, monthly AS (SELECT series_id, last_day(obs_date) AS obs_date, sum(value) AS value FROM daily WHERE obs_date < DATE '2001-08-01' GROUP BY 1, 2)"
PAIRS = f"{MONTHLY}, shipped AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS obs_date, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1), pairs AS (SELECT series_id, obs_date, value AS p, t FROM monthly JOIN shipped USING (obs_date))"
VINTAGES = "vs AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS obs_date, last_day(CAST(l_shipdate AS DATE)) AS vintage_date, sum(l_extendedprice) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) GROUP BY 1, 2), vint AS (SELECT obs_date, vintage_date, round(sum(v) OVER (PARTITION BY obs_date ORDER BY vintage_date), 2) AS value FROM vs)"


def corr_sql(p: str, t: str, where: str = "TRUE") -> str:
    """Guarded moments, in SQL; p and t must be null together."""
    f = f"FILTER (WHERE {where})"
    return f"CASE WHEN count({p}) {f} >= 3 THEN covar_pop({p}, {t}) {f} / nullif(stddev_pop({p}) {f} * stddev_pop({t}) {f}, 0) END"


# Rollup.

END_SQL = {"weekly": "CAST(date_trunc('week', {0}) AS DATE) + 6", "monthly": "last_day({0})", "quarterly": "last_day(CAST(date_trunc('quarter', {0}) AS DATE) + INTERVAL 2 MONTH)", "annual": "make_date(year({0}), 12, 31)"}
HOW_SQL = {"sum": "sum(value)", "mean": "avg(value)", "last": "sum(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)"}


def _rollup(target: str, kind: str, how: str | None):
    def run(spark, d):
        got = rollup(daily(spark, d), source="daily", target=target, variable_type=kind, how=how)
        return got.select("series_id", F.col("obs_date").alias("period_end"), tidy(F.col("value") + 0.000001, 4).alias("value"), "n")  # off the ties, which sums in another order would break

    return run


for _target in END_SQL:
    for _kind, _how in (("flow", "sum"), ("rate", "mean"), ("price", "max"), ("price", "min"), ("rate", "median")):
        if _how in ("sum", "mean") or _target == "monthly":
            _e = END_SQL[_target].format("obs_date")
            query(
                f"""WITH {DAILY}, e AS (SELECT series_id, max(obs_date) AS m FROM daily GROUP BY 1)
                SELECT series_id, CAST({_e} AS DATE) AS period_end, round({HOW_SQL[_how]} + 0.000001, 4) + 0.0 AS value, count(*) AS n
                FROM daily JOIN e USING (series_id) GROUP BY 1, 2, m HAVING CAST({_e} AS DATE) <= m""",
                f"rollup_{_target}_{_how}",
            )(_rollup(_target, _kind, _how))


@query(f"""WITH {PANEL}, spans AS (SELECT series_id, CAST(date_trunc('month', min(obs_date)) AS DATE) AS a, CAST(date_trunc('month', max(obs_date)) AS DATE) AS b FROM (SELECT * FROM panel WHERE month(obs_date) % 3 <> 0) GROUP BY 1),
    spine AS (SELECT series_id, last_day(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)) AS obs_date FROM spans)
    SELECT s.series_id, s.obs_date, round(coalesce(sum(p.value), 0), 2) + 0.0 AS value, count(p.value) AS n FROM spine s LEFT JOIN (SELECT * FROM panel WHERE month(obs_date) % 3 <> 0) p ON s.series_id = p.series_id AND s.obs_date = p.obs_date GROUP BY 1, 2""")
def rollup_spine_gaps(spark, d):
    """Months that a series lacks are there with a sum of zero."""
    got = rollup(panel(spark, d).where(F.month("obs_date") % 3 != 0), source="daily", target="monthly", variable_type="flow")
    return got.select("series_id", "obs_date", tidy("value", 2).alias("value"), "n")


@query(f"""WITH {DAILY}, m AS (SELECT series_id, last_day(obs_date) AS e, max(max(obs_date)) OVER (PARTITION BY series_id) AS l FROM daily GROUP BY 1, 2)
    SELECT series_id, 'daily' AS source_cadence, 'monthly' AS target_cadence, 'sum' AS aggregation, count(*) FILTER (WHERE e <= l) AS periods_created, max(e) > max(l) AS partial_dropped, CAST(0 AS BIGINT) AS missing_periods FROM m GROUP BY 1""")
def rollup_audit_monthly(spark, d):
    rows = daily(spark, d)
    got = rollup(rows, source="daily", target="monthly", variable_type="flow")
    return rollup_audit(rows, got, source="daily", target="monthly", variable_type="flow").select("series_id", "source_cadence", "target_cadence", "aggregation", "periods_created", "partial_dropped", "missing_periods")


@query(f"WITH {MONTHLY} SELECT series_id, obs_date + 45 AS obs_date, round(value, 2) + 0.0 AS value FROM monthly")
def release_lag(spark, d):
    return apply_release_lag(monthly(spark, d), 45).select("series_id", "obs_date", tidy("value", 2).alias("value"))


@query(f"WITH {DAILY} SELECT {', '.join(f'CAST({s.format('obs_date')} AS DATE) AS {c}' for c, s in END_SQL.items())}, count(*) AS n FROM daily GROUP BY ALL")
def period_snap(spark, d):
    rows = daily(spark, d)
    return rows.groupBy(*(period_end("obs_date", c).alias(c) for c in END_SQL)).agg(F.count(F.lit(1)).alias("n"))


# Transforms.

W = "OVER (PARTITION BY series_id ORDER BY obs_date)"
PCT = "value / nullif(lag(value, {0}) {1}, 0) - 1"
TRANSFORM_SQL = {"raw": "value", "diff": f"value - lag(value, 1) {W}"} | {n: PCT.format(k, W) for n, k in (("pct_change", 1), ("mom_1p", 1), ("mom_3p", 3), ("yoy_1y", YEAR["monthly"]), ("yo2y", 2 * YEAR["monthly"]))}
for _n in (3, 6, 12, 24):
    _f = f"OVER (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN {_n - 1} PRECEDING AND CURRENT ROW)"
    TRANSFORM_SQL |= {f"rolling_mean_{_n}": f"CASE WHEN count(value) {_f} = {_n} THEN avg(value) {_f} END", f"rolling_sum_{_n}": f"CASE WHEN count(value) {_f} = {_n} THEN sum(value) {_f} END", f"zscore_{_n}": f"CASE WHEN count(value) {_f} = {_n} THEN (value - avg(value) {_f}) / nullif(stddev_pop(value) {_f}, 0) END"}


def _transform(name: str):
    return lambda spark, d: apply_transform(panel(spark, d), name, out="x").select("series_id", "obs_date", tidy("x", 5 if "sum" not in name else 2).alias("x"))


for _name in TRANSFORMS:
    query(f"WITH {PANEL} SELECT series_id, obs_date, round({TRANSFORM_SQL[_name]}, {2 if 'sum' in _name else 5}) + 0.0 AS x FROM panel", f"transform_{_name}")(_transform(_name))


@query(f"WITH {PANEL} SELECT series_id, obs_date, round(lag(value, 2) {W}, 2) + 0.0 AS x, round(lead(value, 1) {W}, 2) + 0.0 AS y FROM panel")
def lag_shift(spark, d):
    return panel(spark, d).select("series_id", "obs_date", tidy(lag(2), 2).alias("x"), tidy(lag(-1), 2).alias("y"))


# Grid and backtest.


def _grid(spark, d):
    rows = monthly(spark, d)
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    features, _ = plan_features([Predictor(n, ("raw", "mom_3p", "zscore_12"), (0, 1, 2)) for n in names], 60, 2)
    return build_grid(rows, features)


GRID = f"""{PAIRS}, wide AS (SELECT series_id, obs_date, value AS raw, {TRANSFORM_SQL['mom_3p']} AS mom_3p, {TRANSFORM_SQL['zscore_12']} AS zscore_12 FROM monthly),
    long AS (SELECT series_id, obs_date, 'raw' AS tf, raw AS v FROM wide UNION ALL SELECT series_id, obs_date, 'mom_3p', mom_3p FROM wide UNION ALL SELECT series_id, obs_date, 'zscore_12', zscore_12 FROM wide),
    grid AS (SELECT series_id || '::' || tf || '::lag_' || k AS feature_id, obs_date, rn, CASE k WHEN 0 THEN v WHEN 1 THEN l1 ELSE l2 END AS value, k FROM (SELECT *, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, row_number() OVER w AS rn FROM long WINDOW w AS (PARTITION BY series_id, tf ORDER BY obs_date)) CROSS JOIN (VALUES (0), (1), (2)) AS ks(k))"""


@query(f"WITH {GRID} SELECT feature_id, count(*) AS n, count(value) AS n_known, round(sum(value), 3) + 0.0 AS total FROM grid WHERE rn > k GROUP BY 1")
def feature_grid_long(spark, d):
    return _grid(spark, d).groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), tidy(F.sum("value"), 3).alias("total"))


@query(f"""WITH {GRID}, j AS (SELECT feature_id, obs_date, CASE WHEN value IS NOT NULL AND t IS NOT NULL THEN value END AS p, CASE WHEN value IS NOT NULL AND t IS NOT NULL THEN t END AS t FROM grid JOIN shipped USING (obs_date)),
    s AS (SELECT feature_id, {corr_sql('p', 't', "obs_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'")} AS a, {corr_sql('p', 't', "obs_date BETWEEN DATE '1999-01-01' AND DATE '2001-07-31'")} AS b, count(p) FILTER (WHERE obs_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') AS n_train, count(p) FILTER (WHERE obs_date BETWEEN DATE '1999-01-01' AND DATE '2001-07-31') AS n_test FROM j GROUP BY 1)
    SELECT feature_id, round(a, 6) + 0.0 AS r_train, round(b, 6) + 0.0 AS r_test, n_train, n_test, CAST(row_number() OVER (ORDER BY round(abs(a), 9) DESC NULLS LAST, feature_id) AS INTEGER) AS rank FROM s""")
def signal_backtest(spark, d):
    """The flagship: every feature of the grid against shipped value, ranked by its correlation in the train period."""
    got = backtest.score_features(_grid(spark, d), shipped(spark, d), ("1995-01-01", "1998-12-31"), ("1999-01-01", "2001-07-31"))
    rank = F.row_number().over(Window.orderBy(F.round(F.abs("r_train"), 9).desc_nulls_last(), "feature_id"))  # 45 features
    return got.select("feature_id", tidy("r_train").alias("r_train"), tidy("r_test").alias("r_test"), "n_train", "n_test", rank.alias("rank"))


RANKED = "ranked AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY p) + (count(*) OVER (PARTITION BY series_id, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY series_id ORDER BY t) + (count(*) OVER (PARTITION BY series_id, t) - 1) / 2.0 AS rt FROM pairs)"


@query(f"""WITH {PAIRS}, {RANKED} SELECT series_id, count(*) AS n, round({corr_sql('p', 't')}, 6) + 0.0 AS corr, round({corr_sql('rp', 'rt')}, 6) + 0.0 AS rank_corr, round(avg(CASE WHEN sign(p) = sign(t) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS directional_accuracy, round(avg(abs(p - t)), 2) + 0.0 AS mae,
    round(CASE WHEN min(t) > 0 THEN avg(abs((p - t) / t)) * 100 END, 6) + 0.0 AS mape, round(sqrt(avg((p - t) * (p - t))), 2) + 0.0 AS rmse FROM ranked GROUP BY 1""")
def kpi_metrics(spark, d):
    got = backtest.kpi_metrics(pairs(spark, d), ["series_id"])
    return got.select("series_id", "n", *(tidy(c, 2 if c in ("mae", "rmse") else 6).alias(c) for c in ("corr", "rank_corr", "directional_accuracy", "mae", "mape", "rmse")))


@query(f"WITH {PAIRS}, {RANKED} SELECT series_id, round({corr_sql('rp', 'rt')}, 6) + 0.0 AS rho FROM ranked GROUP BY 1")
def spearman(spark, d):
    rows = pairs(spark, d).withColumn("rp", average_rank("p", ["series_id"])).withColumn("rt", average_rank("t", ["series_id"]))
    return rows.groupBy("series_id").agg(tidy(pearson("rp", "rt")).alias("rho"))


@query(f"""WITH {PAIRS}, ks AS (SELECT unnest(range(7)) AS lag), m AS (SELECT series_id, CAST(lag AS INTEGER) AS lag, t, lag(p, CAST(lag AS INTEGER)) OVER (PARTITION BY series_id, lag ORDER BY obs_date) AS p FROM pairs CROSS JOIN ks)
    SELECT series_id, lag, round(corr(p, t), 3) + 0.0 AS corr FROM m WHERE p IS NOT NULL GROUP BY 1, 2""".replace("lag(p, CAST(lag AS INTEGER))", "lag(p, CAST(ks.lag AS INTEGER))").replace("PARTITION BY series_id, lag ORDER", "PARTITION BY series_id, ks.lag ORDER").replace("CAST(lag AS INTEGER) AS lag", "CAST(ks.lag AS INTEGER) AS lag"))
def lead_lag_profile(spark, d):
    rows = pairs(spark, d)
    w = Window.partitionBy("series_id").orderBy("obs_date")
    wide = rows.select("series_id", "t", *(F.lag("p", k).over(w).alias(f"p{k}") for k in range(7))).groupBy("series_id").agg(*(pearson(f"p{k}", "t").alias(f"r{k}") for k in range(7)))
    return wide.select("series_id", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), tidy(f"r{k}", 3).alias("corr")) for k in range(7)))).alias("x")).select("series_id", "x.*")


HALVES = f"{PAIRS}, h AS (SELECT series_id, {corr_sql('p', 't', chr(34) + 'obs_date' + chr(34) + ' < DATE ' + chr(39) + '1998-07-01' + chr(39))} AS a, {corr_sql('p', 't', 'obs_date >= DATE ' + chr(39) + '1998-07-01' + chr(39))} AS b FROM pairs GROUP BY 1)"


def _halves(spark, d):
    early = F.col("obs_date") < "1998-07-01"
    return pairs(spark, d).groupBy("series_id").agg(pearson("p", "t", early).alias("a"), pearson("p", "t", ~early).alias("b"))


@query(f"WITH {HALVES} SELECT series_id, round((a - b) / nullif(a, 0) * 100, 1) + 0.0 AS lost, coalesce(abs(b) >= 0.1 AND (sign(a) = sign(b) OR a = 0) AND ((a - b) / nullif(a, 0) * 100 IS NULL OR round((a - b) / nullif(a, 0) * 100, 2) <= 50), false) AS survives FROM h")
def oos_degradation(spark, d):
    return _halves(spark, d).select("series_id", tidy(ratio(F.col("a") - F.col("b"), "a") * 100, 1).alias("lost"), backtest.survives(F.col("a"), F.col("b")).alias("survives"))


@query(f"WITH {HALVES} SELECT series_id, round(a, 6) + 0.0 AS before, round(b, 6) + 0.0 AS after, CASE WHEN a * b < 0 THEN 100.0 ELSE round(abs(a - b) / nullif(greatest(abs(a), abs(b)), 0) * 100, 2) END + 0.0 AS dispersion FROM h")
def regime_split(spark, d):
    a, b = F.col("a"), F.col("b")
    spread = F.when(a * b < 0, F.lit(100.0)).otherwise(tidy(ratio(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))) * 100, 2))
    return _halves(spark, d).select("series_id", tidy("a").alias("before"), tidy("b").alias("after"), spread.alias("dispersion"))


@query(f"""WITH {MONTHLY}, r AS (SELECT series_id, obs_date, row_number() OVER w AS rn, first(obs_date) OVER w AS train_start, lag(obs_date) OVER w AS train_end, lead(obs_date, 2) OVER w AS test_end FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY obs_date))
    SELECT series_id, train_start, train_end, obs_date AS test_start, test_end FROM r WHERE rn > 24 AND (rn - 25) % 3 = 0 AND test_end IS NOT NULL""")
def walk_forward_windows(spark, d):
    return backtest.walk_forward_windows(monthly(spark, d), min_train=24, step=3, by=["series_id"])


# Statistics.

RHO = f"{PANEL}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id) AS x FROM panel), l AS (SELECT series_id, x, {', '.join(f'lag(x, {k}) {W} AS x{k}' for k in (1, 2, 3, 4))} FROM c), rho AS (SELECT series_id, count(*) AS n, {', '.join(f'sum(x * x{k}) / sum(x * x) AS r{k}' for k in (1, 2, 3, 4))} FROM l GROUP BY 1)"


@query(f"WITH {RHO} SELECT series_id, round(r1, 6) + 0.0 AS r1, round(r2, 6) + 0.0 AS r2, round(r3, 6) + 0.0 AS r3, round(r4, 6) + 0.0 AS r4, n FROM rho")
def autocorrelations(spark, d):
    rho = statistics.autocorrelations(panel(spark, d), ["series_id"], 4)
    return rho.groupBy("series_id", "n").agg(*(tidy(F.max(F.when(F.col("lag") == k, F.col("rho")))).alias(f"r{k}") for k in (1, 2, 3, 4)))


@query(f"WITH {RHO} SELECT series_id, round(n * (n + 2) * ({' + '.join(f'r{k} * r{k} / (n - {k})' for k in (1, 2, 3, 4))}), 4) + 0.0 AS q FROM rho")
def ljung_box_q(spark, d):
    return statistics.ljung_box(statistics.autocorrelations(panel(spark, d), ["series_id"], 4), ["series_id"]).select("series_id", tidy("q", 4).alias("q"))


@query(f"WITH {RHO}, k AS (SELECT series_id, n, 1 + 2 * ({' + '.join(f'(1 - {k} / n) * r{k} * r{k}' for k in (1, 2, 3, 4))}) AS c FROM rho) SELECT series_id, round(CASE WHEN c <= 0 THEN n ELSE greatest(3.0, least(CAST(n AS DOUBLE), n / c)) END, 4) + 0.0 AS n_eff FROM k".replace("1 / n", "1.0 / n").replace("2 / n", "2.0 / n").replace("3 / n", "3.0 / n").replace("4 / n", "4.0 / n"))
def bartlett_neff(spark, d):
    rho = statistics.autocorrelations(panel(spark, d), ["series_id"], 4)
    return statistics.effective_sample_size(rho, rho, ["series_id"]).select("series_id", tidy("n_eff", 4).alias("n_eff"))


@query(f"""WITH {PANEL}, g AS (SELECT series_id, obs_date, value - lag(value) {W} AS x FROM panel), s AS (SELECT series_id, sign(x) AS s, lag(sign(x)) {W} AS b FROM g WHERE x IS NOT NULL AND x <> 0),
    a AS (SELECT series_id, CAST(count(*) FILTER (WHERE s > 0) AS DOUBLE) AS u, CAST(count(*) FILTER (WHERE s < 0) AS DOUBLE) AS w, 1 + count(*) FILTER (WHERE s <> b) AS runs FROM s GROUP BY 1)
    SELECT series_id, CAST(runs AS BIGINT) AS runs, round((runs - (2 * u * w / (u + w) + 1)) / sqrt(2 * u * w * (2 * u * w - u - w) / ((u + w) * (u + w) * (u + w - 1))), 5) + 0.0 AS z FROM a""")
def runs_test_z(spark, d):
    got = statistics.runs_test(apply_transform(panel(spark, d), "diff", out="x"), ["series_id"], value="x")
    return got.select("series_id", F.col("runs").cast("long").alias("runs"), tidy("z", 5).alias("z"))


@query(f"""WITH {PAIRS} SELECT series_id, obs_date, round(CASE WHEN count(p) OVER w = 12 THEN covar_pop(p, t) OVER w / nullif(stddev_pop(p) OVER w * stddev_pop(t) OVER w, 0) END, 5) + 0.0 AS r FROM pairs WINDOW w AS (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_corr(spark, d):
    return statistics.rolling_correlation(pairs(spark, d), ["series_id"], 12, out="r").select("series_id", "obs_date", tidy("r", 5).alias("r"))


@query(f"WITH {PAIRS}, r AS (SELECT series_id, count(*) AS n, corr(p, t) AS r FROM pairs GROUP BY 1) SELECT series_id, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) + 0.0 AS ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) + 0.0 AS ci_high, round(sqrt((1 - r * r) / (n - 2)), 6) + 0.0 AS se FROM r")
def corr_ci_fisher(spark, d):
    r = pairs(spark, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), pearson("p", "t").alias("r"))
    return r.select("series_id", *statistics.correlation_interval("r", "n")).select("series_id", *(tidy(c).alias(c) for c in ("ci_low", "ci_high", "se")))


@query(f"""WITH {PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS i FROM pairs), dd AS (SELECT a.series_id, a.i, b.i AS j, abs(a.p - b.p) AS da, abs(a.t - b.t) AS db FROM x a JOIN x b USING (series_id)),
    c AS (SELECT series_id, da - avg(da) OVER (PARTITION BY series_id, i) - avg(da) OVER (PARTITION BY series_id, j) + avg(da) OVER (PARTITION BY series_id) AS a, db - avg(db) OVER (PARTITION BY series_id, i) - avg(db) OVER (PARTITION BY series_id, j) + avg(db) OVER (PARTITION BY series_id) AS b FROM dd)
    SELECT series_id, round(sqrt(avg(a * b) / sqrt(avg(a * a) * avg(b * b))), 5) + 0.0 AS dcor FROM c GROUP BY 1""")
def distance_corr(spark, d):
    return statistics.distance_correlation(pairs(spark, d), ["series_id"]).select("series_id", tidy("dcor", 5).alias("dcor"))


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM pairs), z AS (SELECT *, CASE WHEN rn <= floor(n * 0.2) THEN 'bottom' WHEN rn > n - floor(n * 0.2) THEN 'top' END AS tail FROM k) SELECT series_id, tail, count(*) AS n, round(corr(p, t), 5) + 0.0 AS r FROM z WHERE tail IS NOT NULL GROUP BY 1, 2")
def tail_corr(spark, d):
    return statistics.tails(pairs(spark, d), ["series_id"]).groupBy("series_id", "tail").agg(F.count(F.lit(1)).alias("n"), tidy(pearson("p", "t"), 5).alias("r"))


LOGISTIC = "1 / (1 + exp(1.702 * abs(r) * sqrt(n)))"


def _tests(spark, d):
    """A rough p-value of each nation's lag-one autocorrelation, by a logistic curve, in both engines alike."""
    rho = statistics.autocorrelations(panel(spark, d), ["series_id"], 4).where("lag = 1")
    return rho.select("series_id", F.round(2 * F.expr(LOGISTIC.replace("r)", "rho)")), 9).alias("p"))


TESTS = f"{RHO}, tests AS (SELECT series_id, round(2 * {LOGISTIC.replace('abs(r)', 'abs(r1)')}, 9) AS p FROM rho)"


@query(f"WITH {TESTS}, k AS (SELECT *, row_number() OVER (ORDER BY p, series_id) AS i, count(*) OVER () AS m FROM tests), best AS (SELECT coalesce(max(i) FILTER (WHERE p <= i / m * 0.25), 0) AS top FROM k) SELECT series_id, round(p, 6) AS p, i <= top AS rejected FROM k CROSS JOIN best".replace("i / m", "i * 1.0 / m"))
def benjamini_hochberg(spark, d):
    return statistics.benjamini_hochberg(_tests(spark, d), q=0.25, order=["series_id"]).select("series_id", F.round("p", 6).alias("p"), "rejected")


@query(f"WITH {TESTS} SELECT series_id, round(p, 6) AS p, p <= 0.5 / count(*) OVER () AS rejected FROM tests")
def bonferroni(spark, d):
    return statistics.bonferroni(_tests(spark, d), alpha=0.5).select("series_id", F.round("p", 6).alias("p"), "rejected")


@query(f"WITH {PAIRS} SELECT series_id, count(*) AS n, round(sum(p), 1) + 0.0 AS sp, round(regr_slope(t, p), 5) + 0.0 AS slope FROM pairs GROUP BY 1")
def ols_moments(spark, d):
    m = statistics.moments(pairs(spark, d), ["p", "t"], ["series_id"])
    slope = ratio(F.col("s_p_t") - F.col("s_p") * F.col("s_t") / F.col("n"), F.col("s_p_p") - F.col("s_p") * F.col("s_p") / F.col("n"))
    return m.select("series_id", "n", tidy("s_p", 1).alias("sp"), tidy(slope, 5).alias("slope"))


# Vintages.


@query(f"WITH {VINTAGES} SELECT obs_date, min(vintage_date) AS vintage_date, arg_min(value, vintage_date) AS value FROM vint GROUP BY 1")
def vintage_first(spark, d):
    return vintage.first_vintage(vintages(spark, d)).select("obs_date", "vintage_date", "value")


@query(f"WITH {VINTAGES} SELECT obs_date, max(vintage_date) AS vintage_date, arg_max(value, vintage_date) AS value FROM vint GROUP BY 1")
def vintage_final(spark, d):
    return vintage.final_vintage(vintages(spark, d)).select("obs_date", "vintage_date", "value")


@query(f"WITH {VINTAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY obs_date ORDER BY vintage_date) AS i FROM vint) SELECT a.obs_date, round(b.value - a.value, 2) + 0.0 AS value FROM k a JOIN k b USING (obs_date) WHERE a.i = 1 AND b.i = 2")
def vintage_first_revision(spark, d):
    return vintage.first_revision(vintages(spark, d)).select("obs_date", tidy("value", 2).alias("value"))


@query(f"WITH {VINTAGES} SELECT obs_date, arg_max(value, vintage_date) AS value FROM vint WHERE vintage_date <= DATE '1998-06-30' GROUP BY 1")
def vintage_as_of(spark, d):
    return vintage.as_of(vintages(spark, d), "1998-06-30").select("obs_date", "value")


@query(f"WITH {VINTAGES}, ds AS (SELECT DISTINCT vintage_date + 15 AS as_of FROM vint) SELECT as_of, arg_max(obs_date, (obs_date, vintage_date)) AS obs_date, arg_max(value, (obs_date, vintage_date)) AS value FROM ds JOIN vint ON vintage_date <= as_of GROUP BY 1")
def vintage_as_of_series(spark, d):
    v = vintages(spark, d)
    return vintage.as_of_series(v, v.select("series_id", F.date_add("vintage_date", 15).alias("as_of")).distinct()).select("as_of", "obs_date", "value")


REV = f"""{VINTAGES}, f AS (SELECT obs_date, min(vintage_date) AS d0, arg_min(value, vintage_date) AS v0, lag(obs_date) OVER (ORDER BY obs_date) AS b FROM vint GROUP BY 1),
    q AS (SELECT f.obs_date, any_value(d0) AS d0, any_value(v0) AS v0, arg_max(v.value, v.vintage_date) FILTER (WHERE v.obs_date = f.obs_date AND v.vintage_date <= d0 + 90) AS vh, arg_max(v.value, v.vintage_date) FILTER (WHERE v.obs_date = b AND v.vintage_date <= d0) AS p0, arg_max(v.value, v.vintage_date) FILTER (WHERE v.obs_date = b AND v.vintage_date <= d0 + 90) AS ph FROM f JOIN vint v ON v.obs_date = f.obs_date OR v.obs_date = b GROUP BY 1),
    rev AS (SELECT obs_date, d0 AS first_release_date, d0 + 90 AS knowable_date, vh - v0 AS level_rev, (vh - v0) / nullif(abs(v0), 0) AS rel_level_rev, (vh - ph) - (v0 - p0) AS growth_rev FROM q)"""


@query(f"WITH {REV} SELECT obs_date, first_release_date, knowable_date, round(level_rev, 2) + 0.0 AS level_rev, round(rel_level_rev, 5) + 0.0 AS rel_level_rev, round(growth_rev, 2) + 0.0 AS growth_rev FROM rev")
def revisions_fixed_horizon(spark, d):
    got = vintage.revisions(vintages(spark, d), 90)
    return got.select("obs_date", "first_release_date", "knowable_date", tidy("level_rev", 2).alias("level_rev"), tidy("rel_level_rev", 5).alias("rel_level_rev"), tidy("growth_rev", 2).alias("growth_rev"))


SAFE = f"{REV}, safe AS (SELECT a.obs_date, round(arg_max(b.level_rev, b.obs_date), 2) + 0.0 AS x, round(any_value(a.level_rev), 2) + 0.0 AS y FROM rev a JOIN rev b ON b.obs_date < a.obs_date AND b.knowable_date <= a.first_release_date WHERE a.level_rev IS NOT NULL AND b.level_rev IS NOT NULL GROUP BY 1)"


def _safe(spark, d):
    return vintage.safe_pairs(vintage.revisions(vintages(spark, d), 90), "level_rev").select("obs_date", tidy("x", 2).alias("x"), tidy("y", 2).alias("y"))


@query(f"WITH {SAFE} SELECT * FROM safe")
def pit_safe_pairs(spark, d):
    return _safe(spark, d)


@query(f"WITH {SAFE}, k AS (SELECT *, ntile(3) OVER (ORDER BY obs_date) AS third FROM safe) SELECT CAST(third AS INTEGER) AS third, count(*) AS n, round(corr(x, y), 5) + 0.0 AS r FROM k GROUP BY 1")
def subsample_stability(spark, d):
    rows = _safe(spark, d).withColumn("third", F.ntile(3).over(Window.orderBy("obs_date")))  # a row for each month
    return rows.groupBy("third").agg(F.count(F.lit(1)).alias("n"), tidy(pearson("x", "y"), 5).alias("r"))


@query(f"WITH {SAFE}, ds AS (SELECT unnest([DATE '1996-12-31', DATE '1997-12-31', DATE '1998-12-31']) AS split) SELECT split, round(corr(x, y) FILTER (WHERE obs_date <= split), 5) + 0.0 AS r_train, round(corr(x, y) FILTER (WHERE obs_date > split), 5) + 0.0 AS r_test FROM safe CROSS JOIN ds GROUP BY 1")
def oos_split_sensitivity(spark, d):
    dates = F.array(*(F.lit(x).cast("date") for x in ("1996-12-31", "1997-12-31", "1998-12-31")))
    rows = _safe(spark, d).withColumn("split", F.explode(dates))
    early = F.col("obs_date") <= F.col("split")
    return rows.groupBy("split").agg(tidy(pearson("x", "y", early), 5).alias("r_train"), tidy(pearson("x", "y", ~early), 5).alias("r_test"))


@query(f"""WITH {VINTAGES}, a AS (SELECT obs_date, arg_min(value, vintage_date) AS f, arg_max(value, vintage_date) AS l FROM vint GROUP BY 1), g AS (SELECT obs_date, f / nullif(lag(f) OVER (ORDER BY obs_date), 0) - 1 AS f, l / nullif(lag(l) OVER (ORDER BY obs_date), 0) - 1 AS l FROM a),
    h AS (SELECT f, l, lag(f) OVER (ORDER BY obs_date) AS fb, lag(l) OVER (ORDER BY obs_date) AS lb FROM g) SELECT round(corr(f, fb), 5) + 0.0 AS ac1_first, round(corr(l, lb), 5) + 0.0 AS ac1_final FROM h WHERE fb IS NOT NULL""")
def pit_gap(spark, d):
    """Lag-one autocorrelation of monthly growth, as first released and as it stands now."""
    v = vintages(spark, d)
    rows = vintage.first_vintage(v).select("series_id", "obs_date", F.col("value").alias("f")).join(vintage.final_vintage(v).select("series_id", "obs_date", F.col("value").alias("l")), ["series_id", "obs_date"])
    w = Window.partitionBy("series_id").orderBy("obs_date")
    g = rows.select("series_id", "obs_date", *((ratio(c, F.lag(c).over(w)) - 1).alias(c) for c in "fl"))
    h = g.select("f", "l", *(F.lag(c).over(w).alias(c + "b") for c in "fl"))
    return h.agg(tidy(pearson("f", "fb"), 5).alias("ac1_first"), tidy(pearson("l", "lb"), 5).alias("ac1_final"))


# Joins in time.


@query("WITH s AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS at, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), e AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) + 30 AS at, o_orderkey FROM orders) SELECT o_orderkey, e.at, s.v FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.at >= s.at")
def asof_backward(spark, d):
    """The last order of the customer by 30 days after each order."""
    o = read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    known = o.groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("at")).agg(F.max("o_totalprice").alias("v"))
    asked = o.select("o_orderkey", F.col("o_custkey").alias("k"), F.date_add(F.to_date("o_orderdate"), 30).alias("at"))
    return asof_join(asked, known, keys=["k"], left_on="at", right_on="at", values=["v"]).select("o_orderkey", "at", "v")


def _prices(spark, d):
    """Mean order value by segment and day, as prices."""
    o, c = read(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice"), read(spark, d, "customer", "c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 2).alias("close"))


def _events(spark, d):
    """The days whose order value ends in .x7, as catalysts."""
    return _prices(spark, d).where(F.day("date") == 7).select(F.concat_ws("-", "ticker", F.col("date").cast("string")).alias("event_id"), "ticker", F.col("date").alias("catalyst_date"))


PRICES = "prices AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 2) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), rets AS (SELECT *, row_number() OVER w AS rn, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date))"
FEATURES = f"{PRICES}, ev AS (SELECT ticker || '-' || date AS event_id, ticker, date, rn AS a FROM rets WHERE day(date) = 7), feats AS (SELECT event_id, any_value(e.ticker) AS ticker, {', '.join(f'CASE WHEN count(ret) FILTER (WHERE r.rn - a BETWEEN {a} AND {b}) = {b - a + 1} THEN sum(ret) FILTER (WHERE r.rn - a BETWEEN {a} AND {b}) END AS {n}' for n, (a, b) in events.WINDOWS.items())} FROM ev e JOIN rets r ON e.ticker = r.ticker AND r.rn BETWEEN a - 60 AND a + 21 GROUP BY 1)"


@query(f"WITH {FEATURES} SELECT event_id, ticker, {', '.join(f'round({n}, 3) + 0.0 AS {n}' for n in events.WINDOWS)} FROM feats")
def event_window_cum(spark, d):
    got = events.event_features(_events(spark, d), _prices(spark, d))
    return got.select("event_id", "ticker", *(tidy(n, 3).alias(n) for n in events.WINDOWS))


@query(f"WITH {FEATURES}, r AS (SELECT ticker, round(pre_runup, 6) AS x, round(event_reaction, 6) AS y, event_id FROM feats WHERE pre_runup IS NOT NULL AND event_reaction IS NOT NULL), c AS (SELECT ticker, quantile_cont(x, 2.0 / 3) AS cut FROM r GROUP BY 1), b AS (SELECT *, ntile(5) OVER (PARTITION BY ticker ORDER BY x, y) AS q FROM r JOIN c USING (ticker)) SELECT ticker, round(avg(y) FILTER (WHERE q = 1), 4) + 0.0 AS q1, round(avg(y) FILTER (WHERE q = 5), 4) + 0.0 AS q5, round(avg(y) FILTER (WHERE q = 5) - avg(y) FILTER (WHERE q = 1), 4) + 0.0 AS spread, round(avg(CASE WHEN y < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE x >= cut), 4) + 0.0 AS share, count(*) AS n FROM b GROUP BY 1")
def quintile_spread(spark, d):
    f = events.event_features(_events(spark, d), _prices(spark, d)).select("ticker", F.round("pre_runup", 6).alias("pre_runup"), F.round("event_reaction", 6).alias("event_reaction"))
    got = events.cross_section(f, ["ticker"])
    return got.select("ticker", tidy("q1", 4).alias("q1"), tidy("q5", 4).alias("q5"), tidy("spread", 4).alias("spread"), tidy("top_tercile_share_negative", 4).alias("share"), "n")


NEWS = "news AS (SELECT c_mktsegment AS ticker, CAST(o_orderdate AS DATE) AS date, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment < 'G' GROUP BY 1, 2)"


def _news(spark, d):
    """Orders a day as articles, of some segments only."""
    o, c = read(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice"), read(spark, d, "customer", "c_custkey", "c_mktsegment")
    rows = o.join(c, o.o_custkey == c.c_custkey).where("c_mktsegment < 'G'")
    return rows.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("article_count"), F.avg("o_totalprice").alias("avg_tone"))


@query(f"""WITH {FEATURES}, {NEWS}, told AS (SELECT event_id, sum(k) AS told FROM ev JOIN news USING (ticker) WHERE news.date BETWEEN ev.date - 30 AND ev.date - 2 GROUP BY 1), r AS (SELECT ticker, pre_runup AS x, post_drift AS y, coalesce(event_reaction, 0) AS c, told FROM feats LEFT JOIN told USING (event_id) WHERE pre_runup IS NOT NULL AND post_drift IS NOT NULL),
    g AS (SELECT *, count(*) OVER w AS n, count(told) OVER w >= 0.5 * count(*) OVER w AS uses, coalesce(told, avg(told) OVER w) AS v FROM r WINDOW w AS (PARTITION BY ticker)), z AS (SELECT ticker, n, uses, y - avg(y) OVER w AS y, c - avg(c) OVER w AS c, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS a, CASE WHEN uses THEN coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) ELSE 0 END AS b FROM g WHERE n >= 12 WINDOW w AS (PARTITION BY ticker)),
    s1 AS (SELECT *, b - c * sum(b * c) OVER w / sum(c * c) OVER w AS rb, a - c * sum(a * c) OVER w / sum(c * c) OVER w AS ra FROM z WINDOW w AS (PARTITION BY ticker)), s2 AS (SELECT *, ra - rb * coalesce(sum(ra * rb) OVER w / nullif(sum(rb * rb) OVER w, 0), 0) AS rr, rb - ra * sum(ra * rb) OVER w / sum(ra * ra) OVER w AS rn FROM s1 WINDOW w AS (PARTITION BY ticker))
    SELECT ticker, any_value(n) AS n, any_value(uses) AS uses_news, round(sum(rr * y) / sum(rr * rr), 5) + 0.0 AS runup_coef, CASE WHEN any_value(uses) THEN round(sum(rn * y) / sum(rn * rn), 5) + 0.0 END AS news_coef FROM s2 GROUP BY 1""")
def event_regression(spark, d):
    """Each segment's drift after events on run-up, news before them where it is known, and reaction; in SQL by residuals, one regressor after the other."""
    got = events.event_regression(events.event_features(_events(spark, d), _prices(spark, d), _news(spark, d)), ["ticker"])
    return got.select("ticker", "n", "uses_news", tidy("runup_coef", 5).alias("runup_coef"), tidy("news_coef", 5).alias("news_coef"))


@query()
def sell_the_news(spark, d):
    """The whole cross-section; intervals are drawn by a generator that SQL hasn't."""
    return events.sell_the_news(events.event_features(_events(spark, d), _prices(spark, d), _news(spark, d)), ["ticker"])


# Strategies.

STRAT = f"{PRICES}, sg AS (SELECT *, ret AS s, greatest(-1.0, least(1.0, ret / nullif(stddev_samp(ret) OVER (PARTITION BY ticker), 0) / 3)) AS k FROM rets), ps AS (SELECT *, lag(k) OVER (PARTITION BY ticker ORDER BY date) AS pos FROM sg), tn AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY ticker ORDER BY date), 0)) AS turn FROM ps), net AS (SELECT *, pos * ret - turn * 0.001 AS net FROM tn)"


def _strategy(spark, d):
    rows = events.returns(_prices(spark, d)).withColumnRenamed("ret", "signal")
    return strategy.strategy_returns(rows, ["ticker"])


@query(f"WITH {STRAT} SELECT ticker, count(net) AS n, round(sum(turn), 4) + 0.0 AS turnover, round(avg(net) * 252, 4) + 0.0 AS x1, round(avg(CASE WHEN pos IS NOT NULL THEN pos * ret - turn * 0.005 END) * 252, 4) + 0.0 AS x5 FROM net GROUP BY 1")
def turnover_cost(spark, d):
    rows = _strategy(spark, d)
    sums = rows.groupBy("ticker").agg(F.count("net").alias("n"), tidy(F.sum("turnover"), 4).alias("turnover"))
    costs = strategy.cost_sensitivity(rows, ["ticker"]).groupBy("ticker").agg(*(tidy(F.max(F.when(F.col("factor") == k, F.col("net_return"))), 4).alias(f"x{k}") for k in (1, 5)))
    return sums.join(costs, "ticker")


@query(f"WITH {STRAT}, v AS (SELECT ticker, net * 0.01 AS r, date FROM net WHERE net IS NOT NULL), c AS (SELECT ticker, quantile_cont(r, 0.05) AS q FROM v GROUP BY 1), e AS (SELECT ticker, date, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY date)) AS e FROM v), dd AS (SELECT ticker, min(e / m - 1) AS dd FROM (SELECT *, max(e) OVER (PARTITION BY ticker ORDER BY date) AS m FROM e) GROUP BY 1) SELECT v.ticker, count(*) AS n, round(stddev_samp(r) * sqrt(252), 5) + 0.0 AS vol, round((avg(r) * 252 - 0.03) / (stddev_samp(r) * sqrt(252)), 5) + 0.0 AS sharpe, round(any_value(q), 6) + 0.0 AS var_95, round(avg(r) FILTER (WHERE r <= q), 6) + 0.0 AS cvar_95, round(any_value(dd), 5) + 0.0 AS max_drawdown FROM v JOIN c USING (ticker) JOIN dd USING (ticker) GROUP BY 1")
def strategy_metrics(spark, d):
    got = strategy.metrics(_strategy(spark, d).withColumn("net", F.col("net") * 0.01), ["ticker"])
    return got.select("ticker", "n", *(tidy(c, k).alias(c) for c, k in (("vol", 5), ("sharpe", 5), ("var_95", 6), ("cvar_95", 6), ("max_drawdown", 5))))


# Analogues: parts as events.


def _corpus(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.select(F.col("p_partkey").cast("string").alias("event_id"), F.col("p_brand").alias("moa"), F.concat_ws("-", "p_type", (F.col("p_size") % 10).cast("string")).alias("indication"), F.col("p_type").alias("disease_area"), F.col("p_size").cast("string").alias("target"), (F.col("p_partkey") % 3).cast("string").alias("modality"), (F.col("p_partkey") % 4).cast("string").alias("phase"), F.array((F.col("p_partkey") % 5).cast("string"), (F.col("p_size") % 7).cast("string")).alias("tags"), F.when(F.col("p_partkey") % 7 < 3, "success").when(F.col("p_partkey") % 7 < 5, "failure").when(F.col("p_partkey") % 7 == 5, "mixed").otherwise("unknown").alias("outcome"))


CORPUS = """corpus AS (SELECT CAST(p_partkey AS VARCHAR) AS event_id, p_brand AS moa, p_type || '-' || CAST(p_size % 10 AS VARCHAR) AS indication, p_type AS disease_area, CAST(p_size AS VARCHAR) AS target, CAST(p_partkey % 3 AS VARCHAR) AS modality, CAST(p_partkey % 4 AS VARCHAR) AS phase, [CAST(p_partkey % 5 AS VARCHAR), CAST(p_size % 7 AS VARCHAR)] AS tags, CASE WHEN p_partkey % 7 < 3 THEN 'success' WHEN p_partkey % 7 < 5 THEN 'failure' WHEN p_partkey % 7 = 5 THEN 'mixed' ELSE 'unknown' END AS outcome FROM part),
    scored AS (SELECT q.event_id AS query_id, c.event_id, q.outcome AS q_outcome, c.outcome, CAST((q.disease_area = c.disease_area) AS INT) * 2 + CAST((q.indication = c.indication) AS INT) * 3 + CASE WHEN q.moa = c.moa THEN 3 WHEN q.target = c.target THEN 2 ELSE 0 END + CAST((q.modality = c.modality) AS INT) + CAST((q.phase = c.phase) AS INT) + len(list_distinct(list_intersect(q.tags, c.tags))) AS score FROM corpus q JOIN corpus c ON q.event_id <> c.event_id AND (q.indication = c.indication OR q.moa = c.moa OR q.target = c.target)), found AS (SELECT * FROM scored WHERE score >= 4)"""


@query(f"WITH {CORPUS} SELECT query_id, event_id, CAST(score AS INTEGER) AS score FROM found")
def refclass_retrieve(spark, d):
    c = _corpus(spark, d)
    return analogues.retrieve(c, c).select("query_id", "event_id", F.col("score").cast("int").alias("score"))


RATES = "count(*) AS n, {0}round(avg(CASE outcome WHEN 'success' THEN 1.0 WHEN 'failure' THEN 0.0 ELSE 0.5 END), 6) + 0.0 AS weighted_success_rate"


@query(f"WITH {CORPUS} SELECT disease_area, moa, {RATES.format('round(avg(CASE WHEN outcome = ' + chr(39) + 'success' + chr(39) + ' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p_success, ')}, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN count(*) < 5 THEN 'low' WHEN count(*) < 8 THEN 'medium' ELSE 'high' END AS confidence FROM corpus GROUP BY 1, 2 HAVING count(*) >= 2")
def refclass_base_rates(spark, d):
    got = analogues.class_base_rates(_corpus(spark, d), ["disease_area", "moa"])
    return got.select("disease_area", "moa", "n", tidy("p_success").alias("p_success"), tidy("weighted_success_rate").alias("weighted_success_rate"), "confidence")


@query(f"WITH {CORPUS}, pr AS (SELECT query_id, any_value(q_outcome) AS o, avg(CASE outcome WHEN 'success' THEN 1.0 WHEN 'failure' THEN 0.0 ELSE 0.5 END) AS p FROM found WHERE q_outcome IN ('success', 'failure') GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS n, round(avg(p) FILTER (WHERE o = 'success'), 5) + 0.0 AS mean_p_success, round(avg(p) FILTER (WHERE o = 'failure'), 5) + 0.0 AS mean_p_failure, round(avg(CASE WHEN (p >= 0.5) = (o = 'success') THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS accuracy, round(avg((p - CAST(o = 'success' AS INT)) ** 2), 5) + 0.0 AS brier FROM pr")
def refclass_loo(spark, d):
    got = analogues.leave_one_out(_corpus(spark, d))
    return got.select("n", *(tidy(c, 5).alias(c) for c in ("mean_p_success", "mean_p_failure", "accuracy", "brier")))


# Registry: sources of documents as a catalog.


def _catalog(spark, d):
    """A source for each nation, a dataset for each region and nation."""
    n = read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    arr = lambda *c: F.array(*(F.lit(x) if isinstance(x, str) else x for x in c))
    k = F.col("n_nationkey")
    sources = n.select(k.cast("string").alias("id"), F.col("n_name").alias("name"), F.when(k % 2 == 0, "finance-markets").otherwise("economy").alias("domain"), F.when(k % 5 == 0, "panel").when(k % 5 == 1, "registry").otherwise("time-series").alias("entry_kind"), F.concat(F.lit("series of "), F.lower("n_name"), F.when(k % 4 == 0, " with revisions").otherwise("")).alias("description"), F.when(k % 3 == 0, arr("DATE", "ISO_3")).when(k % 3 == 1, arr("TICKER")).otherwise(arr("DATE", "TICKER")).alias("join_keys"), arr("id").alias("primary_keys"), F.when(k % 6 == 0, arr("global")).otherwise(arr("us", "eu")).alias("geography"), arr("monthly prices").alias("use_cases"), F.when(k % 2 == 0, "1 month").alias("lag"), F.when(k % 3 == 0, arr("rest-api")).otherwise(arr("scrape")).alias("type"), F.when(k % 4 == 1, "paid").otherwise("free").alias("cost"), F.when(k % 7 == 0, "api-key").otherwise("none").alias("auth_required"), F.lit("x").alias("license"), F.lit("monthly").alias("frequency"), F.lit("").alias("homepage_url"))
    listed = n.where(k % 2 == 1).select(F.concat(F.lit("d"), k.cast("string")).alias("id"), k.cast("string").alias("source_id"), F.col("n_name").alias("name"), F.lit("time-series").alias("entry_kind"), F.lit("date").alias("time_index"), F.when(k % 3 == 0, arr("daily", "monthly")).otherwise(arr("annual")).alias("time_grain"), arr("id").alias("primary_keys"), F.when(k % 3 == 0, arr("DATE", "ISO_3")).otherwise(arr("TICKER")).alias("join_keys"), F.lit(True).alias("is_catalog"))
    fields = listed.select("source_id", F.col("id").alias("dataset_id"), F.lit("value").alias("name"), F.lit("double").alias("type"), F.lit("measure").alias("role"), F.lit(None).cast("string").alias("join_key"), F.lit(1).alias("ordinal"))
    return registry.Catalog(sources, registry.all_datasets(sources, listed), fields, fields.limit(0))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(CAST(contains(lower(n_name || ' series of ' || n_name), 'a') AS INT) + CAST(n_nationkey % 4 = 0 AS INT) + CAST(n_nationkey % 3 <> 1 AS INT) AS INTEGER) AS score FROM nation WHERE n_nationkey % 2 = 0 ORDER BY score DESC, lower(n_name), id LIMIT 8")
def registry_search_topk(spark, d):
    return registry.search_sources(_catalog(spark, d), "a revisions date", domain="finance-markets", limit=8).select("id", "score")


@query("WITH k AS (SELECT n_nationkey AS i, CASE n_nationkey % 3 WHEN 0 THEN ['DATE', 'ISO_3'] WHEN 1 THEN ['TICKER'] ELSE ['DATE', 'TICKER'] END AS ks FROM nation), p AS (SELECT a.i AS a, b.i AS b, a.ks AS ka, b.ks AS kb, list_filter(b.ks, lambda x: list_contains(a.ks, x)) AS dr FROM k a JOIN k b ON a.i < b.i) SELECT CAST(a AS VARCHAR) AS source_id, CAST(b AS VARCHAR) AS target_id, CAST(len(dr) AS INTEGER) AS n, CASE WHEN len(dr) = 0 THEN 'incompatible' WHEN len(dr) = 1 AND NOT list_contains(dr, 'DATE') THEN 'weak' WHEN list_contains(dr, 'DATE') AND NOT list_contains(dr, 'ISO_3') AND (list_contains(ka, 'ISO_3') OR list_contains(kb, 'ISO_3')) THEN 'medium' WHEN list_contains(dr, 'DATE') AND list_contains(dr, 'ISO_3') THEN 'strong' ELSE 'medium' END AS join_quality FROM p")
def join_path_quality(spark, d):
    s = _catalog(spark, d).sources.select("id", "join_keys", F.lit(1).alias("_one"))  # 25 sources
    both = s.select(F.col("id").alias("source_id"), F.col("join_keys").alias("source_keys"), "_one").join(s.select(F.col("id").alias("target_id"), F.col("join_keys").alias("target_keys"), "_one"), "_one").where("cast(source_id as int) < cast(target_id as int)")
    return registry.assess_joins(both).select("source_id", "target_id", F.size("direct").alias("n"), "join_quality")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(1 + CAST(n_nationkey % 3 = 0 AS INT) AS INTEGER) AS overlap FROM nation WHERE n_nationkey <> 3 AND n_nationkey % 3 <> 1 ORDER BY overlap DESC, lower(n_name), id LIMIT 10")
def compatible_overlap(spark, d):
    return registry.compatible_sources(_catalog(spark, d), "d3", 10).select("id", "overlap")


@query("""WITH d AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 2 = 1 THEN 'd' || n_nationkey ELSE CAST(n_nationkey AS VARCHAR) END AS id, CASE WHEN n_nationkey % 2 = 0 THEN 3 WHEN n_nationkey % 3 = 0 THEN 10 ELSE 3 END AS cadence, CASE WHEN n_nationkey % 2 = 0 THEN 5 WHEN n_nationkey % 3 = 0 THEN 10 ELSE 3 END AS cf FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 5 <> 0),
    a AS (SELECT id, CAST(least(10, 2 + round_even((CAST(contains('monthly prices', 'prices') AS INT) + CAST(contains(lower(n_name), 'zzzz') AS INT)) * 8 / 2.0, 0)) AS INTEGER) AS economic_proximity, CASE WHEN k % 6 = 0 THEN 9 ELSE 7 END AS coverage, cf AS cadence_fit, CASE WHEN k % 2 = 0 THEN 8 ELSE 4 END AS release_lag_clarity, CASE WHEN k % 4 = 0 THEN 3 WHEN k % 5 = 1 THEN 8 WHEN k % 5 = 0 THEN 5 ELSE 6 END AS point_in_time_safety, CASE WHEN k % 2 = 0 AND k % 5 <> 1 THEN 4 ELSE 8 END AS survivorship_bias_risk, CASE WHEN k % 3 = 0 THEN 9 ELSE 4 END AS api_scriptability, CASE WHEN k % 4 = 1 THEN 3 ELSE 10 END - CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS cost_access_practicality FROM d)
    SELECT id, economic_proximity, coverage, cadence_fit, release_lag_clarity, point_in_time_safety, survivorship_bias_risk, api_scriptability, cost_access_practicality FROM a""")
def dataset_fit_score(spark, d):
    got = registry.fitness(_catalog(spark, d), {"statement": "prices zzzz", "target_cadence": "monthly"})
    return got.drop("fit")


# Quality, families, scalars.


@query("SELECT 'c_acctbal' AS field, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS missing FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (WHERE c_mktsegment = 'BUILDING') FROM customer")
def field_audit_missing(spark, d):
    c = read(spark, d, "customer", "c_acctbal", "c_mktsegment").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(" ").alias("c_mktsegment"))
    return quality.missing_by_field(c).select("field", "n", "missing")


@query("WITH s AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part) SELECT p_partkey, 'p_retailprice' AS field, round((p_retailprice - m) / s, 5) + 0.0 AS z FROM part CROSS JOIN s WHERE abs((p_retailprice - m) / s) > 1.5")
def field_audit_outliers(spark, d):
    return quality.outliers_by_field(read(spark, d, "part", "p_partkey", "p_retailprice"), "p_partkey", ["p_retailprice"], z=1.5).select("p_partkey", "field", tidy("z", 5).alias("z"))


@query(f"WITH {PAIRS}, ks AS (SELECT unnest([0, 1, 2]) AS k), m AS (SELECT series_id, k, obs_date, t, lag(p, CAST(k AS INTEGER)) OVER (PARTITION BY series_id, k ORDER BY obs_date) AS p FROM pairs CROSS JOIN ks) SELECT series_id AS term, CAST(k AS INTEGER) AS lag, round(corr(p, t) FILTER (WHERE obs_date <= DATE '1998-12-31' AND p IS NOT NULL), 5) + 0.0 AS r_train, round(corr(p, t) FILTER (WHERE obs_date > DATE '1998-12-31' AND p IS NOT NULL), 5) + 0.0 AS r_test, count(p) FILTER (WHERE obs_date > DATE '1998-12-31') AS n_test FROM m GROUP BY 1, 2")
def family_matrix(spark, d):
    got = quality.family_matrix(pairs(spark, d).withColumnRenamed("series_id", "term"), [0, 1, 2], "1998-12-31")
    return got.select("term", "lag", tidy("r_train", 5).alias("r_train"), tidy("r_test", 5).alias("r_test"), "n_test")


@query(f"WITH {PAIRS}, s AS (SELECT series_id, sign(corr(p, t)) AS s FROM pairs GROUP BY 1) SELECT a.series_id AS a, b.series_id AS b, CASE WHEN a.s = 0 OR b.s = 0 THEN 'neutral' WHEN a.s = b.s THEN 'agree' ELSE 'contradict' END AS verdict FROM s a JOIN s b ON a.series_id < b.series_id")
def contradiction_matrix(spark, d):
    signs = pairs(spark, d).groupBy(F.col("series_id").alias("signal_id")).agg(F.signum(pearson("p", "t")).alias("sign"))
    return quality.contradictions(signs)


@query("SELECT o_orderkey, o_totalprice AS p FROM orders")
def pvalue_parse(spark, d):
    o = read(spark, d, "orders", "o_orderkey", "o_totalprice")
    return o.select("o_orderkey", p_value(F.concat(F.lit(" <="), F.col("o_totalprice").cast("string"))).alias("p"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_first_value(spark, d):
    e = read(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), 0).alias("first_value"))

PART_FIELDS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _as_text(spark, d):
    """Parts as a file of text would have them."""
    p = read(spark, d, "part", "p_partkey", *(c for c in PART_FIELDS if c != "p_partkey"))
    return p.select("p_partkey", *(F.col(c).cast("string").alias(c) for c in PART_FIELDS if c != "p_partkey"))


@query("WITH t AS (SELECT p_partkey, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in PART_FIELDS[1:]) + " FROM part), f AS (SELECT * FROM t ORDER BY p_partkey LIMIT 20), long AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS field, TRY_CAST({c} AS DOUBLE) AS value FROM t WHERE (SELECT bool_and(TRY_CAST({c} AS DOUBLE) IS NOT NULL) FROM f)" for c in PART_FIELDS[1:]) + "), s AS (SELECT field, avg(value) AS m, stddev_samp(value) AS sd FROM long GROUP BY 1 HAVING count(value) >= 4) SELECT p_partkey, field, round((value - m) / sd, 5) + 0.0 AS z FROM long JOIN s USING (field) WHERE abs((value - m) / sd) > 1.5")
def sniffed_outliers(spark, d):
    """Outliers of the fields that the first rows show to be numbers."""
    return quality.audit(_as_text(spark, d), "p_partkey", ["p_partkey"], z=1.5)[1].select("p_partkey", "field", tidy("z", 5).alias("z"))


LOCKED = ("p_brand", "p_partkey", "p_size", "p_type")


def _row_md5(price: str) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("p_brand", "p_partkey", price, "p_type")) + ")"


@query(f"WITH a AS (SELECT p_partkey, {_row_md5('p_size')} AS d FROM part), b AS (SELECT p_partkey, {_row_md5('s')} AS d FROM (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_size <> 7 UNION ALL SELECT -p_partkey, p_brand, p_type, p_size FROM part WHERE p_size = 9)) SELECT p_partkey, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (p_partkey) WHERE a.d IS DISTINCT FROM b.d")
def table_changes(spark, d):
    """What differs between the parts and a later state of them: some gone, some new, some of another size."""
    old = read(spark, d, "part", *LOCKED)
    new = old.where("p_size != 7").withColumn("p_size", F.when(F.col("p_size") > 40, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return locks.changes(old, new.unionByName(old.where("p_size = 9").withColumn("p_partkey", -F.col("p_partkey"))), "p_partkey")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(sum(CAST('0x' || substr(m, 1, 8) AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || substr(m, 9, 8) AS BIGINT)) AS BIGINT) AS high FROM (SELECT md5({' || chr(124) || '.join(f'coalesce(length(CAST({c} AS VARCHAR)) || chr(58) || CAST({c} AS VARCHAR), chr(45))' for c in sorted(cs))}) AS m FROM {t})" for t, cs in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("part", LOCKED))))
def table_digests(spark, d):
    found = None
    for t, columns in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("part", LOCKED)):
        got = locks.digest(read(spark, d, t, *columns)).select(F.lit(t).alias("name"), "n", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
        found = got if found is None else found.union(got)
    return found


# Verdicts on many signals: each nation's orders as a predictor of what is shipped.


def signal_pairs(spark, d):
    """Months of each nation with the month's shipped value, where any was shipped: train before 1999, test from then on."""
    rows = panel(spark, d).withColumnRenamed("value", "p").join(shipped(spark, d).withColumnRenamed("value", "t"), "obs_date", "left")
    return rows.select(F.col("series_id").alias("signal_id"), "obs_date", F.when(F.col("obs_date") < "1999-01-01", "train").otherwise("test").alias("part"), "p", "t")


def _judged(spark, d):
    pairs = signal_pairs(spark, d)
    signals = pairs.select("signal_id").distinct().select("signal_id", F.lit(3).alias("features_tested"), F.lit(True).alias("regime_split"), F.when(F.length("signal_id") > 1, "medium").otherwise("high").alias("confidence_cap"))
    return verdicts.judge(pairs, signals)


# The checks that SQL can say, in their order among all.
CHECK_ORDER = {"sample_size": 0, "missingness": 1, "outliers": 2, "lag_sensitivity": 7, "outlier_sensitivity": 8, "regime_split": 10}

SIGNALS = f"""{PANEL}, shipped AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS obs_date, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1), sp AS (SELECT series_id AS signal_id, obs_date, value AS p, t, obs_date < DATE '1999-01-01' AS early FROM panel LEFT JOIN shipped USING (obs_date)), ids AS (SELECT DISTINCT signal_id FROM sp),
    te AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY obs_date) AS i, lag(p) OVER (PARTITION BY signal_id ORDER BY obs_date) AS p1 FROM sp WHERE NOT early), ok AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY obs_date) AS k, count(*) OVER (PARTITION BY signal_id) AS n FROM te WHERE p IS NOT NULL AND t IS NOT NULL),
    z AS (SELECT signal_id, t, abs(t - avg(t) OVER (PARTITION BY signal_id)) > 4 * stddev_pop(t) OVER (PARTITION BY signal_id) AS far FROM te WHERE t IS NOT NULL),
    far AS (SELECT *, abs((p - avg(p) OVER s) / stddev_pop(p) OVER s) + abs((t - avg(t) OVER s) / stddev_pop(t) OVER s) AS away FROM ok WINDOW s AS (PARTITION BY signal_id)), e AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY away DESC, k) AS extreme FROM far),
    r AS (SELECT signal_id, any_value(n) AS n, corr(p, t) AS r0, corr(p1, t) AS r1, corr(p, t) FILTER (WHERE extreme > greatest(1, round(0.01 * n))) AS rest, corr(p, t) FILTER (WHERE k <= n // 2) AS ra, corr(p, t) FILTER (WHERE k > n // 2) AS rb FROM e GROUP BY 1),
    va AS (SELECT 'sample_size' AS "check", signal_id, CAST(n AS DOUBLE) AS value, CASE WHEN n >= 120 THEN 'pass' WHEN n >= 30 THEN 'warn' ELSE 'fail' END AS verdict FROM r
           UNION ALL SELECT 'missingness', signal_id, v, CASE WHEN v >= 25 THEN 'fail' WHEN v >= 5 THEN 'warn' ELSE 'pass' END FROM (SELECT signal_id, round(100.0 * count(*) FILTER (WHERE t IS NULL) / count(*), 2) AS v FROM te GROUP BY 1)
           UNION ALL SELECT 'outliers', signal_id, v, CASE WHEN v = 0 AND n >= 4 THEN 'pass' WHEN n < 4 OR v / n < 0.01 THEN 'warn' ELSE 'fail' END FROM (SELECT signal_id, CASE WHEN count(*) >= 4 THEN CAST(count(*) FILTER (WHERE far) AS DOUBLE) END AS v, count(*) AS n FROM z GROUP BY 1)
           UNION ALL SELECT 'lag_sensitivity', signal_id, v, CASE WHEN v <= 30 THEN 'pass' ELSE 'warn' END FROM (SELECT signal_id, round((abs(round(r0, 4)) - abs(round(r1, 4))) / abs(round(r0, 4)) * 100, 2) AS v FROM r)
           UNION ALL SELECT 'outlier_sensitivity', signal_id, v, CASE WHEN v <= 30 THEN 'pass' ELSE 'warn' END FROM (SELECT signal_id, CASE WHEN n >= 20 THEN round((abs(r0) - abs(rest)) / abs(r0) * 100, 2) END AS v FROM r)
           UNION ALL SELECT 'regime_split', signal_id, v, CASE WHEN v <= 50 THEN 'pass' ELSE 'warn' END FROM (SELECT signal_id, CASE WHEN n // 2 < 8 THEN NULL WHEN ra * rb < 0 THEN 100.0 ELSE round(abs(ra - rb) / greatest(abs(ra), abs(rb)) * 100, 2) END AS v FROM r))"""


@query(f'WITH {SIGNALS} SELECT signal_id, "check", verdict, round(value, 1) + 0.0 AS value FROM va')
def signal_checks(spark, d):
    checks = _judged(spark, d)[1].where(F.col("check").isin(*CHECK_ORDER))
    return checks.select("signal_id", "check", "verdict", tidy("value", 1).alias("value"))


@query(f"""WITH {SIGNALS}, places(name, place) AS (VALUES {", ".join(f"('{n}', {k})" for n, k in CHECK_ORDER.items())}), oos AS (SELECT signal_id, corr(p, t) FILTER (WHERE early) AS a, corr(p, t) FILTER (WHERE NOT early) AS b FROM sp GROUP BY 1),
    limits AS (SELECT signal_id, "check" AS name, place, CASE verdict WHEN 'pass' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END AS tier FROM va JOIN places ON name = "check" UNION ALL SELECT signal_id, 'feature_search', 1000, CASE WHEN length(signal_id) > 1 THEN 2 ELSE 3 END FROM ids
               UNION ALL SELECT signal_id, 'out_of_sample', 1001, CASE WHEN abs(b) >= 0.1 AND sign(a) = sign(b) AND round((a - b) / a * 100, 2) <= 50 THEN 2 ELSE 1 END FROM oos)
    SELECT signal_id, CASE min(tier) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence_cap, arg_min(name, tier * 10000 + place) AS binding_constraint FROM limits GROUP BY 1""")
def signal_gate(spark, d):
    """The gate over the checks that SQL can say, and survival by correlations alone."""
    pairs = signal_pairs(spark, d)
    signals = verdicts.declared(pairs.select("signal_id").distinct().select("signal_id", F.lit(True).alias("regime_split"), F.when(F.length("signal_id") > 1, "medium").otherwise("high").alias("confidence_cap")), ["signal_id"])
    signals = signals.join(verdicts.panels(pairs, ["signal_id"]), "signal_id").withColumn("survives", backtest.survives(F.col("train.corr"), F.col("test.corr")))
    checks = verdicts.check_rows(pairs.where("part = 'test'"), signals, ["signal_id"])
    return verdicts.gate(checks.where(F.col("check").isin(*CHECK_ORDER)), signals, ["signal_id"])


@query()
def signal_verdicts(spark, d):
    """All of a verdict; p-values have no SQL."""
    return _judged(spark, d)[0]


# Studies: families of trials.


def _rev(horizon: int, name: str) -> str:
    return REV.replace("90", str(horizon)).replace(" q AS", f" q{name} AS").replace("FROM q)", f"FROM q{name})").replace("rev AS (", f"rev{name} AS (").replace(f"{VINTAGES}, ", "").replace("f AS (SELECT obs_date, min", f"f{name} AS (SELECT obs_date, min").replace("FROM f JOIN", f"FROM f{name} f JOIN")


TRIALS = f"""{VINTAGES}, {_rev(30, "_30")}, {_rev(90, "_90")}, rv AS (SELECT 30 AS horizon, * FROM rev_30 UNION ALL SELECT 90, * FROM rev_90), lv AS (SELECT horizon, 'level_rev' AS unit, obs_date, first_release_date, knowable_date, round(level_rev, 2) AS v FROM rv WHERE level_rev IS NOT NULL UNION ALL SELECT horizon, 'growth_rev', obs_date, first_release_date, knowable_date, round(growth_rev, 2) FROM rv WHERE growth_rev IS NOT NULL),
    tp AS (SELECT a.horizon, a.unit, a.obs_date, arg_max(b.v, b.obs_date) AS x, any_value(a.v) AS y FROM lv a JOIN lv b ON a.horizon = b.horizon AND a.unit = b.unit AND b.obs_date < a.obs_date AND b.knowable_date <= a.first_release_date GROUP BY 1, 2, 3)"""


def bootstrap_sql(rows: str, keys: str, statistic: str, block: int = 12, reps: int = 2000, seed: int = 12345) -> str:
    """Tables that end in ``limits`` (keys, low, high), from the table ``rows`` (keys, i from 1, x, y): blocks by the same hashes, statistics of the drawn rows themselves."""
    return f"""bn AS (SELECT {keys}, count(*) AS n, CAST(ceil(count(*) / {block}.0) AS BIGINT) AS k FROM {rows} GROUP BY ALL HAVING count(*) >= {2 * block}), bj AS (SELECT *, unnest(range(k)) AS j FROM bn), br AS (SELECT *, unnest(range({reps})) AS r FROM bj),
    bd AS (SELECT {keys}, r, CAST('0x' || substr(md5('{seed}:' || r || ':' || j), 1, 8) AS BIGINT) % (n - {block - 1}) AS s, CASE WHEN j < k - 1 THEN {block} ELSE n - (k - 1) * {block} END AS m FROM br), bi AS (SELECT {keys}, r, unnest(range(s + 1, s + m + 1)) AS i FROM bd),
    bs AS (SELECT {keys}, r, {statistic} AS v FROM bi JOIN {rows} USING ({keys}, i) GROUP BY ALL), limits AS (SELECT {keys}, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM bs WHERE isfinite(v) GROUP BY ALL)"""


def student_sql(r: str, n: str) -> str:
    """The two-sided p-value of a correlation: Simpson's rule over Student's density, in the angle at which it has no tail."""
    df, steps = f"({n} - 2)", 400
    area = f"list_sum([CASE WHEN g IN (0, {steps}) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * pow(cos(asin(least(1, abs({r}))) * g / {steps}), {df} - 1) for g in range({steps + 1})]) * asin(least(1, abs({r}))) / {steps} / 3"
    return f"CASE WHEN {n} > 2 THEN greatest(0, 1 - 2 * {area} * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi())) END"


NORMAL_SQL = "1 - 2 * list_sum([CASE WHEN g IN (0, 400) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs(z) * g / 400, 2) / 2) for g in range(401)]) * abs(z) / 400 / 3 / sqrt(2 * pi())"


@query(f"""WITH {TRIALS}, trials AS (SELECT unit, CAST(horizon AS INTEGER) AS horizon, count(*) AS full_n, count(*) FILTER (WHERE obs_date >= DATE '1999-01-01') AS oos_n, {corr_sql("x", "y")} AS full_r, CASE WHEN count(*) FILTER (WHERE obs_date >= DATE '1999-01-01') >= 4 THEN {corr_sql("x", "y", "obs_date >= DATE '1999-01-01'")} END AS oos_r, unit = 'growth_rev' AND horizon = 90 AS "primary" FROM tp GROUP BY unit, horizon HAVING count(*) >= 8),
    bx AS (SELECT unit, CAST(horizon AS INTEGER) AS horizon, x, y, row_number() OVER (PARTITION BY unit, horizon ORDER BY obs_date) AS i FROM tp WHERE x IS NOT NULL AND y IS NOT NULL), {bootstrap_sql("bx", "unit, horizon", "corr(x, y)")},
    tested AS (SELECT *, {student_sql("full_r", "full_n")} AS full_p, {student_sql("oos_r", "oos_n")} AS oos_p FROM trials LEFT JOIN limits USING (unit, horizon)), corrected AS (SELECT *, CASE WHEN "primary" THEN least(full_p * count(*) FILTER (WHERE "primary") OVER (), 1) END AS full_p_bonferroni FROM tested)
    SELECT 'all' AS series_id, unit, horizon, full_n, oos_n, round(full_r, 4) + 0.0 AS full_r, round(oos_r, 4) + 0.0 AS oos_r, "primary", round(low, 4) + 0.0 AS ci_low, round(high, 4) + 0.0 AS ci_high, round(full_p, 4) + 0.0 AS full_p, round(oos_p, 4) + 0.0 AS oos_p, round(full_p_bonferroni, 4) + 0.0 AS full_p_bonferroni, coalesce(full_p_bonferroni < 0.05 AND (low > 0 OR high < 0), FALSE) AS primary_survives FROM corrected""")
def momentum_trials(spark, d):
    v = vintages(spark, d)
    trials = studies.momentum_trials(studies.momentum_pairs(v, horizons=(30, 90), units=("level_rev", "growth_rev")), split="1999-01-01")
    return trials.select("series_id", "unit", "horizon", "full_n", "oos_n", "primary", "primary_survives", *(tidy(c, 4).alias(c) for c in ("full_r", "oos_r", "ci_low", "ci_high", "full_p", "oos_p", "full_p_bonferroni")))


@query(f"""WITH {PANEL}, g AS (SELECT series_id, obs_date, value - lag(value) {W} AS x FROM panel), s AS (SELECT series_id, obs_date, sign(x) AS s, lag(sign(x)) {W} AS b FROM g WHERE x IS NOT NULL AND x <> 0), bx AS (SELECT series_id, CAST(s = b AS INT) AS x, row_number() {W} AS i FROM s WHERE b IS NOT NULL), {bootstrap_sql("bx", "series_id", "avg(x)")},
    c AS (SELECT series_id, count(b) AS n_pairs, avg(CAST(s = b AS INT)) AS share, CAST(1 + count(*) FILTER (WHERE s <> b) AS BIGINT) AS runs, CAST(count(*) FILTER (WHERE s > 0) AS DOUBLE) AS up, CAST(count(*) FILTER (WHERE s < 0) AS DOUBLE) AS down FROM s GROUP BY 1 HAVING count(b) >= 23),
    e AS (SELECT *, 2 * up * down / (up + down) + 1 AS expected, 2 * up * down * (2 * up * down - up - down) / (pow(up + down, 2) * (up + down - 1)) AS var FROM c), w AS (SELECT *, (runs - expected) / nullif(sqrt(var), 0) AS z FROM e)
    SELECT series_id, n_pairs, round(share, 5) + 0.0 AS same_sign_share, runs, round(low, 4) + 0.0 AS share_ci_low, round(high, 4) + 0.0 AS share_ci_high, round(expected, 4) + 0.0 AS expected_runs, round(z, 4) + 0.0 AS runs_z, round({NORMAL_SQL}, 4) + 0.0 AS runs_p FROM w LEFT JOIN limits USING (series_id)""")
def sign_persistence(spark, d):
    got = studies.sign_persistence(apply_transform(panel(spark, d), "diff", out="x"), "x")
    return got.select("series_id", "n_pairs", tidy("same_sign_share", 5).alias("same_sign_share"), F.col("runs").cast("long").alias("runs"), *(tidy(c, 4).alias(c) for c in ("share_ci_low", "share_ci_high", "expected_runs", "runs_z", "runs_p")))


@query(f"""WITH {PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS i FROM pairs), dd AS (SELECT o.series_id, o.obs_date, a.i, b.i AS j, abs(a.p - b.p) AS da, abs(a.t - b.t) AS db FROM x o JOIN x a ON a.series_id = o.series_id AND a.i BETWEEN o.i - 12 AND o.i - 1 JOIN x b ON b.series_id = o.series_id AND b.i BETWEEN o.i - 12 AND o.i - 1 WHERE o.i > 12),
    c AS (SELECT series_id, obs_date, da - avg(da) OVER (PARTITION BY series_id, obs_date, i) - avg(da) OVER (PARTITION BY series_id, obs_date, j) + avg(da) OVER (PARTITION BY series_id, obs_date) AS a, db - avg(db) OVER (PARTITION BY series_id, obs_date, i) - avg(db) OVER (PARTITION BY series_id, obs_date, j) + avg(db) OVER (PARTITION BY series_id, obs_date) AS b FROM dd)
    SELECT series_id, obs_date, round(sqrt(greatest(0, avg(a * b) / sqrt(avg(a * a) * avg(b * b)))), 4) + 0.0 AS dcor FROM c GROUP BY 1, 2""")
def rolling_distance_corr(spark, d):
    return studies.rolling_distance_correlation(pairs(spark, d), 12).select("series_id", "obs_date", tidy("dcor", 4).alias("dcor"))


@query(f"""WITH {PAIRS}, ks AS (SELECT unnest([1, 2, 5]) AS k), m AS (SELECT series_id, CAST(k AS INTEGER) AS lag, obs_date, t, lag(p, CAST(k AS INTEGER)) OVER (PARTITION BY series_id, k ORDER BY obs_date) AS p FROM pairs CROSS JOIN ks), w AS (SELECT *, count(*) OVER r AS n, corr(p, t) OVER r AS c FROM m WHERE p IS NOT NULL WINDOW r AS (PARTITION BY series_id, lag ORDER BY obs_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
    g AS (SELECT series_id, lag, count(*) AS n, round(corr(p, t), 5) + 0.0 AS r, avg(CASE WHEN n = 12 AND c > 0 THEN 1.0 ELSE 0.0 END) AS share FROM w GROUP BY 1, 2) SELECT series_id, lag, n, r, round(share, 5) + 0.0 AS rolling_pct_positive, CASE WHEN share > 0.8 THEN 'stable' WHEN share > 0.6 THEN 'moderate' ELSE 'unstable' END AS stability FROM g""")
def lag_stability(spark, d):
    got = studies.lag_stability(pairs(spark, d), [1, 2, 5], window=12)
    return got.select("series_id", "lag", "n", tidy("r", 5).alias("r"), tidy("rolling_pct_positive", 5).alias("rolling_pct_positive"), "stability")

# More joins in time, event studies, and what kernels give where a fixed number of lags has a relational form.


@query(f"WITH {PRICES}, ask AS (SELECT ticker, date + 3 AS at FROM prices WHERE day(date) % 10 = 4) SELECT a.ticker, a.at, min(r.rn) AS anchor_rn FROM ask a LEFT JOIN rets r ON a.ticker = r.ticker AND r.date >= a.at GROUP BY 1, 2")
def anchor_forward(spark, d):
    """The first trading row at or after a day, which need not be one."""
    asked = _prices(spark, d).where(F.day("date") % 10 == 4).select("ticker", F.date_add("date", 3).alias("at"))
    return events.anchored(asked, events.returns(_prices(spark, d)), event_date="at", forward=True).select("ticker", "at", F.col("anchor_rn").cast("long").alias("anchor_rn"))


@query(f"WITH {PRICES}, ev AS (SELECT ticker || '-' || date AS event_id, ticker, date FROM prices WHERE day(date) = 7) SELECT event_id, count(*) AS days, round(avg(close), 2) + 0.0 AS mean_close FROM ev e JOIN prices p ON e.ticker = p.ticker AND p.date BETWEEN e.date - 30 AND e.date - 2 GROUP BY 1")
def calendar_window(spark, d):
    rows = asof.calendar_window(_events(spark, d), _prices(spark, d), key="ticker", event_date="catalyst_date", date="date", low=-30, high=-2)
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("days"), tidy(F.avg("close"), 2).alias("mean_close"))


@query(f"""WITH {PRICES}, market AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY 1), mr AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS m FROM market), ar AS (SELECT ticker, r.date, ret - m AS ar, row_number() OVER (PARTITION BY ticker ORDER BY r.date) AS rn FROM rets r JOIN mr ON r.date = mr.date),
    ev AS (SELECT p.ticker || '-' || p.date AS event_id, p.ticker, min(a.rn) AS a FROM prices p JOIN ar a ON a.ticker = p.ticker AND a.date >= p.date WHERE day(p.date) = 7 GROUP BY 1, 2), w AS (SELECT event_id, rn - a AS offset_, ar FROM ev JOIN ar ON ev.ticker = ar.ticker AND rn BETWEEN a - 5 AND a + 5), f AS (SELECT * FROM w QUALIFY count(ar) OVER (PARTITION BY event_id) = 11), dd AS (SELECT offset_, avg(ar) AS m FROM f GROUP BY 1)
    SELECT CAST(offset_ AS INTEGER) AS "offset", round(m, 4) + 0.0 AS mean_ar, round(sum(m) OVER (ORDER BY offset_), 4) + 0.0 AS caar, (SELECT round(avg(c) / (stddev_samp(c) / sqrt(count(c))), 4) + 0.0 FROM (SELECT sum(ar) AS c FROM f GROUP BY event_id)) AS t FROM dd""")
def event_study_caar(spark, d):
    o = read(spark, d, "orders", "o_orderdate", "o_totalprice")
    market = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 2).alias("close"))
    got = events.abnormal_returns(_events(spark, d), _prices(spark, d), market, -5, 5)
    return got.select(F.col("offset").cast("int").alias("offset"), tidy("mean_ar", 4).alias("mean_ar"), tidy("caar", 4).alias("caar"), tidy("t", 4).alias("t"))


@query(f"WITH {FEATURES} SELECT event_id, round(coalesce((event_reaction - avg(event_reaction) OVER w) / nullif(stddev_samp(event_reaction) OVER w, 0), CASE WHEN event_reaction IS NOT NULL THEN 0.0 END), 4) + 0.0 AS z FROM feats WINDOW w AS (PARTITION BY ticker)")
def event_zscore(spark, d):
    got = events.zscore(events.event_features(_events(spark, d), _prices(spark, d)), "event_reaction", ["ticker"])
    return got.select("event_id", tidy("z_event_reaction", 4).alias("z"))


@query(f"WITH {MONTHLY}, c AS (SELECT 0 AS k, * FROM monthly WHERE obs_date < DATE '1999-01-01' UNION ALL SELECT 1, series_id, obs_date, value + 1 FROM monthly WHERE obs_date > DATE '1998-01-01') SELECT series_id, obs_date, round(arg_min(value, k), 2) + 0.0 AS value FROM c GROUP BY 1, 2")
def stitched_keep_first(spark, d):
    m = monthly(spark, d)
    later = m.where(F.col("obs_date") > "1998-01-01").withColumn("value", F.col("value") + 1)
    return files.stitched([m.where(F.col("obs_date") < "1999-01-01"), later]).select("series_id", "obs_date", tidy("value", 2).alias("value"))


@query("WITH n AS (SELECT n_nationkey AS k FROM nation), s AS (SELECT count(*) AS sources, count(*) FILTER (WHERE k % 2 = 1) AS listed, count(*) FILTER (WHERE k % 2 = 0 AND k % 5 <> 0) AS made FROM n) SELECT 'sources' AS view, sources AS n FROM s UNION ALL SELECT 'fields', listed FROM s UNION ALL SELECT 'join_keys', 0 FROM s UNION ALL SELECT 'datasets without a source', 0 FROM s UNION ALL SELECT 'datasets', listed + made FROM s")
def registry_healthcheck(spark, d):
    return registry.healthcheck(_catalog(spark, d)).select("view", "n")


@query(f"""WITH {PAIRS}, s AS (SELECT series_id, count(*) AS n, sum(p) AS sx, sum(p * p) AS sxx, regr_slope(t, p) AS b, regr_intercept(t, p) AS a, regr_r2(t, p) AS r2 FROM pairs GROUP BY 1), u AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS i, (t - a - b * p) * (n * p - sx) / (n * sxx - sx * sx) AS u FROM pairs JOIN s USING (series_id)),
    v AS (SELECT x.series_id, sum(CASE WHEN x.i = y.i THEN 1 ELSE 2 * (1 - (x.i - y.i) / 13.0) END * x.u * y.u) AS var FROM u x JOIN u y ON x.series_id = y.series_id AND x.i - y.i BETWEEN 0 AND 12 GROUP BY 1) SELECT series_id, round(b, 5) + 0.0 AS slope, round(b / sqrt(var), 4) + 0.0 AS t, round(r2, 5) + 0.0 AS r2 FROM s JOIN v USING (series_id)""")
def ols_hac_slope(spark, d):
    got = per_series(pairs(spark, d), ["series_id"], "obs_date", lambda rows: {"slope": (m := ols_hac(rows["p"].to_numpy(float)[:, None], rows["t"].to_numpy(float)))["coef"][1], "t": m["t"][1], "r2": m["r2"]}, "slope double, t double, r2 double")
    return got.select("series_id", tidy("slope", 5).alias("slope"), tidy("t", 4).alias("t"), tidy("r2", 5).alias("r2"))


@query(f"""WITH {PANEL}, e AS (SELECT series_id, obs_date, value - avg(value) OVER (PARTITION BY series_id) AS e, row_number() {W} AS i, count(*) OVER (PARTITION BY series_id) AS n FROM panel), g AS (SELECT x.series_id, x.i - y.i AS k, any_value(x.n) AS n, sum(x.e * y.e) AS g FROM e x JOIN e y ON x.series_id = y.series_id AND x.i >= y.i GROUP BY 1, 2),
    b AS (SELECT series_id, any_value(n) AS n, sum(CASE WHEN k = 0 THEN g / n WHEN k <= floor(pow(n, 2.0 / 9)) THEN 2 * g / n ELSE 0 END) AS s0, sum(CASE WHEN k BETWEEN 1 AND floor(pow(n, 2.0 / 9)) THEN 2 * k * g / n ELSE 0 END) AS s1 FROM g GROUP BY 1), l AS (SELECT series_id, n, least(n - 1, CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)) AS BIGINT)) AS lags FROM b),
    r AS (SELECT series_id, any_value(lags) AS lags, sum(CASE WHEN k = 0 THEN g / l.n WHEN k <= lags THEN 2 * (1 - k / (lags + 1.0)) * g / l.n ELSE 0 END) AS long_run FROM g JOIN l USING (series_id) GROUP BY 1), c AS (SELECT series_id, sum(s * s) / any_value(n * n) AS ss FROM (SELECT series_id, n, sum(e) OVER (PARTITION BY series_id ORDER BY i) AS s FROM e) GROUP BY 1)
    SELECT series_id, round(ss / long_run, 5) + 0.0 AS stat, CAST(lags AS INTEGER) AS lags FROM r JOIN c USING (series_id)""")
def kpss_statistic(spark, d):
    got = per_series(panel(spark, d), ["series_id"], "obs_date", lambda rows: dict(zip(("stat", "p", "lags"), kpss(rows["value"].to_numpy(float)), strict=True)), "stat double, p double, lags int")
    return got.select("series_id", tidy("stat", 5).alias("stat"), "lags")


@query(f"WITH {PANEL}, x AS (SELECT series_id, value - lag(value) {W} AS dv, lag(value) {W} AS v FROM panel), r AS (SELECT series_id, count(dv) AS n, regr_slope(dv, v) AS b, regr_sxx(dv, v) AS sxx, regr_syy(dv, v) - regr_slope(dv, v) * regr_sxy(dv, v) AS sse FROM x WHERE v IS NOT NULL GROUP BY 1) SELECT series_id, round(b / sqrt(sse / (n - 2) / sxx), 4) + 0.0 AS t FROM r")
def dickey_fuller_t(spark, d):
    """The unit-root statistic without lags."""
    got = per_series(panel(spark, d), ["series_id"], "obs_date", lambda rows: {"t": adf_fit(rows["value"].to_numpy(float), 0, len(rows) - 1, True)[0]}, "t double")
    return got.select("series_id", tidy("t", 4).alias("t"))


@query(f"""WITH {PAIRS}, x AS (SELECT series_id, t AS y, lag(t) {W} AS y1, lag(p) {W} AS x1 FROM pairs), c AS (SELECT series_id, count(*) AS n, corr(y, x1) AS a, corr(y, y1) AS b, corr(x1, y1) AS c FROM x WHERE y1 IS NOT NULL GROUP BY 1), r AS (SELECT series_id, n, pow(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) AS r2 FROM c)
    SELECT series_id, round(r2 / (1 - r2) * (n - 3), 4) + 0.0 AS f FROM r""")
def granger_f_one_lag(spark, d):
    got = per_series(pairs(spark, d), ["series_id"], "obs_date", lambda rows: {"f": granger_f(rows["p"].to_numpy(float), rows["t"].to_numpy(float), 1)[0]}, "f double")
    return got.select("series_id", tidy("f", 4).alias("f"))


# Many columns, and every two series.

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT a, b, n, round(r, 5) + 0.0 AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr({a}, {b}) AS r FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MEASURES)}" for a in MEASURES for b in MEASURES) + ")")
def correlation_matrix(spark, d):
    return wide.correlation_matrix(read(spark, d, "lineitem", *MEASURES), MEASURES).select("a", "b", "n", tidy("r", 5).alias("r"))


@query()
def principal_components(spark, d):
    return wide.principal_components(read(spark, d, "lineitem", *MEASURES), MEASURES)


PANEL_PAIRS = f"""{PANEL}, m AS (SELECT x.series_id AS a, y.series_id AS b, obs_date, x.value AS va, y.value AS vb FROM panel x JOIN panel y USING (obs_date) WHERE x.series_id < y.series_id), l AS (SELECT *, lag(va) OVER w AS la, lag(vb) OVER w AS lb FROM m WINDOW w AS (PARTITION BY a, b ORDER BY obs_date)),
    fit AS (SELECT a, b, count(*) AS n, regr_slope(va, vb) AS slope, regr_intercept(va, vb) AS icept FROM m GROUP BY 1, 2 HAVING count(*) >= 20), e AS (SELECT a, b, obs_date, va - icept - slope * vb AS e FROM m JOIN fit USING (a, b)), de AS (SELECT a, b, e - lag(e) OVER w AS de, lag(e) OVER w AS le FROM e WINDOW w AS (PARTITION BY a, b ORDER BY obs_date)),
    df AS (SELECT a, b, sum(de * le) / sum(le * le) / sqrt((sum(de * de) - pow(sum(de * le), 2) / sum(le * le)) / (count(*) - 1) / sum(le * le)) AS stat FROM de WHERE le IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT a, b, count(*) AS k, var_pop(va - la) AS aa, var_pop(vb - lb) AS bb, covar_pop(va - la, vb - lb) AS ab, var_pop(la) AS pp, var_pop(lb) AS qq, covar_pop(la, lb) AS pq, covar_pop(va - la, la) AS ap, covar_pop(va - la, lb) AS aq, covar_pop(vb - lb, la) AS bp, covar_pop(vb - lb, lb) AS bq FROM l WHERE la IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT *, (pp * qq - pq * pq) AS d1, (aa * bb - ab * ab) AS d0, bb * ap * ap - 2 * ab * ap * bp + aa * bp * bp AS g11, bb * aq * aq - 2 * ab * aq * bq + aa * bq * bq AS g22, bb * ap * aq - ab * (ap * bq + aq * bp) + aa * bp * bq AS g12 FROM c),
    tr AS (SELECT a, b, -k * ln(1 - (qq * g11 - 2 * pq * g12 + pp * g22) / (d1 * d0) + pow(ap * bq - aq * bp, 2) / (d1 * d0)) AS trace FROM j)"""


@query(f"WITH {PANEL_PAIRS} SELECT a, b, n, round(slope, 4) + 0.0 AS slope, round(stat, 4) + 0.0 AS stat, round(trace, 3) + 0.0 AS trace FROM fit JOIN df USING (a, b) JOIN tr USING (a, b)")
def cointegrated_pairs(spark, d):
    """Every two nations: without lagged differences, Engle and Granger's statistic and Johansen's trace are those of moments."""
    found = cointegration.all_pairs(panel(spark, d), lags=0, differences=0, tile_series=8)
    return found.select("a", "b", "n", tidy("slope", 4).alias("slope"), tidy("stat", 4).alias("stat"), tidy(F.col("trace")[0], 3).alias("trace"))


@query()
def cointegration_tests(spark, d):
    """The same with chosen lags, p-values, both traces and the rank; these have no SQL."""
    return cointegration.all_pairs(panel(spark, d), tile_series=8)


# Kernels: no SQL; held against numpy and published values in tests.


def _by_series(kernel, schema):
    return lambda spark, d: per_series(panel(spark, d), ["series_id"], "obs_date", lambda rows: kernel(rows["value"].to_numpy(float)), schema)


query(name="kernel_adf")(_by_series(lambda v: dict(zip(("stat", "p", "lags"), adf(v), strict=True)), "stat double, p double, lags int"))
query(name="kernel_kpss")(_by_series(lambda v: dict(zip(("stat", "p", "lags"), kpss(v), strict=True)), "stat double, p double, lags int"))
query(name="kernel_stl")(_by_series(lambda v: strength(stl(v, 12)), "trend_strength double, seasonal_strength double, durbin_watson double"))


def _by_pairs(kernel, schema):
    return lambda spark, d: per_series(pairs(spark, d), ["series_id"], "obs_date", lambda rows: kernel(rows["p"].to_numpy(float), rows["t"].to_numpy(float)), schema)


query(name="kernel_granger")(_by_pairs(lambda p, t: {"p": granger(p, t)}, "p double"))
query(name="kernel_ols_hac")(_by_pairs(lambda p, t: {k: v for k, v in ols_hac(p[:, None], t).items() if k in ("coef", "t", "r2", "f_p")}, "coef array<double>, t array<double>, r2 double, f_p double"))
query(name="kernel_cointegration")(_by_pairs(lambda p, t: dict(zip(("stat", "p"), engle_granger(p, t), strict=True)) | {"trace": [x["trace"] for x in johansen(np.column_stack([p, t]))]}, "stat double, p double, trace array<double>"))


def _resampled(block: int, statistic: str, sql: str):
    """The interval of each priority's months by 2,000 replicates."""

    @query(f"WITH {PAIRS}, bx AS (SELECT series_id, p AS x, t AS y, row_number() {W} AS i FROM pairs), {bootstrap_sql('bx', 'series_id', sql, block)}, ids AS (SELECT DISTINCT series_id FROM pairs) SELECT series_id, round(low, 5) + 0.0 AS low, round(high, 5) + 0.0 AS high FROM ids LEFT JOIN limits USING (series_id)", f"kernel_{'block' if block > 1 else 'case'}_bootstrap")
    def run(spark, d):
        got = resampling.bootstrap(pairs(spark, d), ["series_id"], statistic, x="p", y="t", block=block, low="low", high="high")
        return got.select("series_id", tidy("low", 5).alias("low"), tidy("high", 5).alias("high"))


_resampled(12, "correlation", "corr(x, y)")
_resampled(1, "slope", "regr_slope(y, x)")
