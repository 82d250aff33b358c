"""Joins in time: as of a date, by position, by calendar, and by any of several keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, keys: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False, suffix: str = "") -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` at or before (``strict``: before) its date, for the same keys.

    One union and one window, whatever the number of probes: no range join, no row pairs. Null where there is none yet; of several
    right rows of a date, the largest values win.
    """
    row = F.struct(*(F.col(v) for v in values))
    kind = F.lit(0 if strict else 1)
    probes = left.select(*keys, F.col(left_on).alias("_at"), kind.alias("_side"), F.struct(*(F.col(c) for c in left.columns)).alias("_left"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    known = right.select(*keys, F.col(right_on).alias("_at"), (1 - kind).alias("_side"), F.lit(None).cast(probes.schema["_left"].dataType).alias("_left"), row.alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side", "_row").rowsBetween(Window.unboundedPreceding, 0)
    seen = probes.unionByName(known).withColumn("_seen", F.last("_row", ignorenulls=True).over(order)).where("_left is not null")
    return seen.select("_left.*", *(F.col(f"_seen.{v}").alias(v + suffix) for v in values))


def position_window(anchors: DataFrame, series: DataFrame, *, key: str, low: int, high: int, position: str = "rn", anchor: str = "anchor_rn") -> DataFrame:
    """Each anchor with the series' rows at positions anchor+low to anchor+high of the same key: one row for each pair.

    Positions are exploded on the (small) side of the anchors, so that the join is by equality.
    """
    wanted = anchors.withColumn("_offset", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(position, F.col(anchor) + F.col("_offset"))
    return wanted.join(series, [key, position]).withColumnRenamed("_offset", "offset")


def calendar_window(events: DataFrame, daily: DataFrame, *, key: str, event_date: str, date: str, low: int, high: int) -> DataFrame:
    """Each event with the rows of its key from ``low`` to ``high`` days around it, by equality on exploded days."""
    wanted = events.withColumn("_offset", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(date, F.date_add(F.col(event_date), F.col("_offset")))
    return wanted.join(daily, [key, date]).withColumnRenamed("_offset", "offset")


#: Pairs that a task compares, and rows that it reads for them.
PAIRS, ROWS = 2_000_000, 1_000_000


def any_key_pairs(left: DataFrame, right: DataFrame, *, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` that agree in any of the keys, all their columns, whose names differ: a union of equi-joins rather than one with an OR.

    Each pair once, in the first key in which it agrees, so pairs are neither shuffled nor made distinct. Sizes of groups are counted first: the
    work is the pairs, so there are as many tasks as they take, and if a group has more pairs than a task's, groups are dealt in rectangles by ids.
    """

    def groups(rows: DataFrame, at: int) -> DataFrame:
        values = F.array(*(F.struct(F.lit(k).alias("key"), F.col(names[at]).cast("string").alias("value")) for k, names in enumerate(keys)))
        return rows.select(F.explode(values).alias("_")).select("_.*").where("value is not null").groupBy("key", "value").agg(F.count(F.lit(1)).cast("double").alias(f"n{at}"))

    counted = groups(left, 0).join(groups(right, 1).hint("merge"), ["key", "value"], "full").na.fill(0, ["n0", "n1"])
    sizes = {r.key: r for r in counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum(F.col("n0") * F.col("n1")).alias("pairs"), F.max(F.col("n0") * F.col("n1")).alias("most")).collect()}
    found = []
    for k, (a, b) in enumerate(keys):
        n0, n1, pairs, most = (sizes[k][c] for c in ("n0", "n1", "pairs", "most")) if k in sizes else (0, 0, 0, 0)
        pieces = math.ceil(most / PAIRS)
        deal = {"_i": max(1, min(pieces, round(math.sqrt(pieces * n0 / n1)))) if n1 else 1}
        deal["_j"] = max(1, math.ceil(pieces / deal["_i"]))  # rows of the left come that often, those of the right "_i" times
        tasks = max(1, math.ceil(pairs / PAIRS), math.ceil((n0 * deal["_j"] + n1 * deal["_i"]) / ROWS))
        by = ["_k", *deal] if pieces > 1 else ["_k"]

        def dealt(rows: DataFrame, key: str, id: str, own: str, other: str, deal: dict[str, int] = deal, by: list[str] = by, tasks: int = tasks) -> DataFrame:
            rows = rows.where(F.col(key).isNotNull()).withColumn("_k", F.col(key))
            if own in by:
                rows = rows.withColumn(own, F.pmod(F.xxhash64(id), F.lit(deal[own])).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(deal[other] - 1))))
            return rows.repartition(tasks, *by)  # a number that is said stays: a few MB would be put together in one task

        both = dealt(left, a, left_id, "_i", "_j").join(dealt(right, b, right_id, "_j", "_i").hint("merge"), by)
        found.append(reduce(DataFrame.where, (~F.coalesce(F.col(x) == F.col(y), F.lit(False)) for x, y in keys[:k]), both).drop(*by))
    return reduce(DataFrame.unionByName, found)
