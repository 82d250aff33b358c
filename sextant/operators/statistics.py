"""Statistics of series and pairs as aggregations and windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import pearson, ratio


def autocorrelations(series: DataFrame, by: list[str], most: int, date: str = "obs_date", value: str = "value") -> DataFrame:
    """Rows (by, lag, rho, n) for lags 1 to ``most``: centred products over all squares; nulls are left out first."""
    w = Window.partitionBy(*by)
    rows = series.where(F.col(value).isNotNull()).withColumn("_x", F.col(value) - F.avg(value).over(w))
    order = Window.partitionBy(*by).orderBy(date)
    wide = rows.select(*by, "_x", *(F.lag("_x", k).over(order).alias(f"_x{k}") for k in range(1, most + 1)))
    sums = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") ** 2).alias("_ss"), *(F.sum(F.col("_x") * F.col(f"_x{k}")).alias(f"_s{k}") for k in range(1, most + 1)))
    got = sums.select(*by, "n", "_ss", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in range(1, most + 1)))).alias("x"))
    return got.where(F.col("n") >= most + 5).select(*by, "x.lag", F.when(F.col("_ss") == 0, 0.0).otherwise(ratio("x.s", "_ss")).alias("rho"), "n")


def ljung_box(rho: DataFrame, by: list[str]) -> DataFrame:
    """Q over the lags that are there."""
    return rho.groupBy(*by, "n").agg((F.sum(ratio(F.col("rho") ** 2, F.col("n") - F.col("lag"))) * F.col("n") * (F.col("n") + 2)).alias("q"), F.max("lag").alias("lags"))


def effective_sample_size(rho_a: DataFrame, rho_b: DataFrame, by: list[str]) -> DataFrame:
    """Bartlett's: n over one plus twice the damped products of both autocorrelations; from 3 up to n."""
    both = rho_a.select(*by, "lag", "n", F.col("rho").alias("a")).join(rho_b.select(*by, "lag", F.col("rho").alias("b")), [*by, "lag"])
    down = both.groupBy(*by, "n").agg((1 + 2 * F.sum((1 - F.col("lag") / F.col("n")) * F.col("a") * F.col("b"))).alias("_c"))
    return down.select(*by, "n", F.when(F.col("_c") <= 0, F.col("n").cast("double")).otherwise(F.greatest(F.lit(3.0), F.least(F.col("n").cast("double"), ratio("n", "_c")))).alias("n_eff"))


def runs_test(series: DataFrame, by: list[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Wald and Wolfowitz's: runs of signs, zeros left out, their expected number, and z."""
    rows = series.where(F.col(value).isNotNull() & (F.col(value) != 0)).withColumn("_s", F.signum(value))
    rows = rows.withColumn("_new", (F.col("_s") != F.lag("_s").over(Window.partitionBy(*by).orderBy(date))).cast("int"))
    got = rows.groupBy(*by).agg(F.sum(F.when(F.col("_s") > 0, 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("_s") < 0, 1).otherwise(0)).alias("down"), (1 + F.sum(F.coalesce("_new", F.lit(0)))).alias("runs"))
    n, ab = F.col("up") + F.col("down"), 2 * F.col("up") * F.col("down")
    mean = ratio(ab, n) + 1
    variance = ratio(ab * (ab - n), n * n * (n - 1))
    return got.select(*by, "up", "down", "runs", mean.alias("expected_runs"), ratio(F.col("runs") - mean, F.sqrt(variance)).alias("z"))


def rolling_correlation(pairs: DataFrame, by: list[str], window: int, date: str = "obs_date", a: str = "p", b: str = "t", out: str = "rolling_corr") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(-(window - 1), 0)
    return pairs.withColumn(out, pearson(a, b, over=w, least=window))


def correlation_interval(r: str, n: str) -> list:
    """Fisher's 95 % interval and the standard error, as columns ci_low, ci_high, se."""
    z, half = F.atanh(F.col(r)), ratio(F.lit(1.96), F.sqrt(F.col(n) - 3))
    return [F.tanh(z - half).alias("ci_low"), F.tanh(z + half).alias("ci_high"), F.sqrt(ratio(1 - F.col(r) * F.col(r), F.col(n) - 2)).alias("se")]


def _left_sums(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place the sums of the rows of ``weights`` over the places before it with a smaller or equal y: merges of halves, of all lengths at once."""
    n = len(y)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), y))] = np.arange(n)
    out, place, width = np.zeros_like(weights), np.arange(n), 1
    while width < n:
        # places in order of rank within each pair of halves; the left half's sums so far are what the right half gets
        order = np.lexsort((rank, place // (2 * width)))
        left = (order // width) % 2 == 0
        sums = np.cumsum(np.where(left, weights[:, order], 0), axis=1)
        first = np.arange(0, n, 2 * width)
        before = np.concatenate([np.zeros((len(weights), 1)), sums], axis=1)[:, first]
        own = sums - before[:, place // (2 * width)]
        out[:, order[~left]] += own[:, ~left]
        width *= 2
    return out


def distance_moments(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Distance covariance, and both distance variances, of n pairs in n log n: no distance is ever held."""
    a, b, n = a - a.mean(), b - b.mean(), len(a)
    rows = []
    for v in (a, b):
        order = np.argsort(v, kind="stable")
        s, before = v[order], np.concatenate([[0.0], np.cumsum(v[order])[:-1]])
        row = np.empty(n)
        row[order] = (2 * np.arange(n) - n) * s - 2 * before  # sums of distances to all others; the whole sum is 0
        rows.append(row)
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    weights = np.stack([np.ones(n), x, y, x * y])
    low = _left_sums(y, weights)
    all_ = np.cumsum(weights, axis=1) - weights
    # (x - x')(y - y') over pairs with x' before x, once as it is and once turned where y' is above y
    signed = lambda w: x * y * w[0] - y * w[1] - x * w[2] + w[3]
    products = 2 * (2 * signed(low) - signed(all_)).sum()
    mean = lambda total, r, s: max(0.0, total / n**2 - 2 * (r @ s) / n**3 + r.sum() * s.sum() / n**4)
    square = lambda v: 2 * n * (v @ v)
    return mean(products, *rows), mean(square(a), rows[0], rows[0]), mean(square(b), rows[1], rows[1])


def distance_correlation(pairs: DataFrame, by: list[str], a: str = "p", b: str = "t") -> DataFrame:
    """(by, n, dcor): the distance correlation of each group's complete pairs, 0 for a constant; a group is sorted in one task, in n log n."""

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows[c].to_numpy() for c in ("a", "b"))
        xy, xx, yy = distance_moments(x, y) if np.ptp(x) and np.ptp(y) else (0.0, 0.0, 0.0)
        value = np.sqrt(xy / np.sqrt(xx * yy)) if xx > 0 and yy > 0 else 0.0
        return pa.table({**{k: rows[k][:1] for k in by}, "n": pa.array([len(x)], pa.int64()), "dcor": pa.array([value], pa.float64())})

    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in by)
    return rows.groupBy(*by).applyInArrow(run, f"{fields}, n long, dcor double")


def tails(pairs: DataFrame, by: list[str], share: float = 0.2, a: str = "p") -> DataFrame:
    """The rows of the lowest and highest ``share`` by ``a``, with ``tail``."""
    w, all_ = Window.partitionBy(*by).orderBy(a), Window.partitionBy(*by)
    rows = pairs.withColumn("_rn", F.row_number().over(w)).withColumn("_k", F.floor(F.count(F.lit(1)).over(all_) * share)).withColumn("_n", F.count(F.lit(1)).over(all_))
    return rows.withColumn("tail", F.when(F.col("_rn") <= F.col("_k"), "bottom").when(F.col("_rn") > F.col("_n") - F.col("_k"), "top")).where("tail is not null").drop("_rn", "_k", "_n")


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: float = 0.05, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``tests`` with ``rejected``: up to the largest rank whose p is within its share of q; a null p never is."""
    by = by or []
    all_ = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = tests.withColumn("_rank", F.row_number().over(all_.orderBy(F.col(p).asc_nulls_last(), *(order or [])))).withColumn("_m", F.count(F.lit(1)).over(all_))
    top = F.max(F.when(F.col(p) <= F.col("_rank") / F.col("_m") * q, F.col("_rank"))).over(all_)
    return ranked.withColumn("rejected", F.col("_rank") <= F.coalesce(top, F.lit(0))).drop("_rank", "_m")


def bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """``tests`` with ``rejected``: p within alpha over the number of tests of the group; groups are counted, never gathered."""
    by = by or []
    keyed = tests.withColumn("_all", F.lit(0))
    counts = keyed.groupBy("_all", *by).agg(F.count(F.lit(1)).alias("_m"))
    joined = keyed.join(F.broadcast(counts) if not by else counts, ["_all", *by])  # without groups one row
    return joined.withColumn("rejected", F.coalesce(F.col(p) <= F.lit(alpha) / F.col("_m"), F.lit(False))).select(*tests.columns, "rejected")


def moments(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n, sums and sums of products of columns over complete rows: all that least squares over a few of them need; wide.products is for many."""
    whole = rows.dropna(subset=columns)
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return whole.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in columns), *(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in names))
