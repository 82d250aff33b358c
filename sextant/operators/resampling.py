"""Bootstrap intervals as rows: replicates are sums of the moments of drawn blocks, and draws are hashes, which SQL can repeat.

The moments of a block are the difference of two running sums, so a replicate of a series of n pairs costs n / block differences and no
resampled rows. A series is a row with its running sums by position; replicates of a row are computed where it stands, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import ratio

SUMS = ("x", "y", "xx", "yy", "xy")

#: Variances under this part of the squares they are made of are those of constants.
ROUNDING = 1e-12


def _spread(n: Column, sums: Column, a: str) -> Column:
    v = n * sums[a * 2] - sums[a] * sums[a]
    return F.when(v > ROUNDING * n * sums[a * 2], v)


#: Statistics of n pairs from their sums: null where there is none.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "correlation": lambda n, s: ratio(n * s["xy"] - s["x"] * s["y"], F.sqrt(_spread(n, s, "x") * _spread(n, s, "y"))),
    "slope": lambda n, s: ratio(n * s["xy"] - s["x"] * s["y"], _spread(n, s, "x")),
    "mean": lambda n, s: ratio(s["x"], n),
}


def drawn(seed: int, rep: Column, draw: Column) -> Column:
    """A number under 2**32 for a draw of a replicate: the first eight hexadecimal digits of the MD5 of ``seed:replicate:draw``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), draw.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def percentile(sorted_values: Column, share: float) -> Column:
    """Linearly interpolated, of an array in order; null if it is empty."""
    at = F.lit(share) * (F.size(sorted_values) - 1)
    low, high = (F.get(sorted_values, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def bootstrap(pairs: DataFrame, by: list[str], statistic: str = "correlation", *, x: str = "x", y: str | None = "y", order: str = "obs_date", block: int = 12, reps: int = 2000, seed: int = 12345, level: float = 0.95, low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """(by, low, high): the interval of a statistic of each group's complete pairs, by ``reps`` replicates of moving blocks.

    ``order`` puts a group's pairs in one order. A replicate has as many pairs as the group: whole blocks of ``block`` pairs from drawn
    starts, the last one cut. ``block`` of 1 resamples single pairs. The interval is null for fewer than two blocks, and where no
    replicate has the statistic; replicates without it are left out.
    """
    x, y = F.col(x).cast("double"), F.col(y or x).cast("double")
    rows = pairs.where(x.isNotNull() & y.isNotNull()).select(*by, order, x.alias("x"), y.alias("y"))
    all_, until = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    # sums are taken around the group's means, so that differences of running sums lose nothing
    rows = rows.withColumns({"mx": F.avg("x").over(all_), "my": F.avg("y").over(all_)})
    a, b = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    running = {"x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    rows = rows.select(*by, order, "mx", F.struct(*(F.sum(v).over(until.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n, v in running.items())).alias("until"))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in SUMS))
    held = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.concat(F.array(zero), F.transform(F.array_sort(F.collect_list(F.struct(order, "until"))), lambda r: r["until"])).alias("sums"))
    n, blocks = F.col("n"), F.ceil(F.col("n") / block).cast("int")

    def replicate(rep: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda draw: F.pmod(drawn(seed, rep, draw), n - block + 1).cast("int"))
        ends = F.transform(starts, lambda a, draw: F.struct(a.alias("a"), (a + F.when(draw < blocks - 1, F.lit(block)).otherwise((n - (blocks - 1) * block).cast("int"))).alias("b")))
        add = lambda sums, d: F.struct(*((sums[k] + F.col("sums")[d["b"]][k] - F.col("sums")[d["a"]][k]).alias(k) for k in SUMS))
        found = F.aggregate(ends, zero, add, lambda sums: STATISTICS[statistic](n, sums))
        return found + F.col("mx") if statistic == "mean" else found

    values = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), replicate), lambda v: v.isNotNull()))
    got = held.where(n >= 2 * block).select(*by, values.alias("values"))
    limits = got.select(*by, percentile(F.col("values"), (1 - level) / 2).alias(low), percentile(F.col("values"), (1 + level) / 2).alias(high))
    return held.select(*by).join(limits, by, "left")
