"""Bitemporal series (obs_date, vintage_date, value): first, final and as-of values, revisions, and pairs without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import ratio

KEYS = ["series_id"]


def known(vintages: DataFrame) -> DataFrame:
    return vintages.where("value is not null")


def first_vintage(vintages: DataFrame, keys=KEYS) -> DataFrame:
    return known(vintages).groupBy(*keys, "obs_date").agg(F.min_by("value", "vintage_date").alias("value"), F.min("vintage_date").alias("vintage_date"))


def final_vintage(vintages: DataFrame, keys=KEYS) -> DataFrame:
    return known(vintages).groupBy(*keys, "obs_date").agg(F.max_by("value", "vintage_date").alias("value"), F.max("vintage_date").alias("vintage_date"))


def first_revision(vintages: DataFrame, keys=KEYS) -> DataFrame:
    """The second vintage less the first, where there are two."""
    w = Window.partitionBy(*keys, "obs_date").orderBy("vintage_date")
    two = known(vintages).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    return two.groupBy(*keys, "obs_date").agg((F.max(F.when(F.col("_n") == 2, F.col("value"))) - F.max(F.when(F.col("_n") == 1, F.col("value")))).alias("value"), F.count(F.lit(1)).alias("_k")).where("_k = 2").drop("_k")


def as_of(vintages: DataFrame, date, keys=KEYS) -> DataFrame:
    """Each observation as it was known at ``date``."""
    return final_vintage(vintages.where(F.col("vintage_date") <= F.lit(date).cast("date")), keys)


def as_of_series(vintages: DataFrame, dates: DataFrame, keys=KEYS, date: str = "as_of") -> DataFrame:
    """For each date (keys, ``date``): the latest observation that had a vintage by then, at its latest vintage by then; else null.

    Of the vintages, running maxima by vintage date hold the answer at each of them, so one as-of window answers all dates.
    """
    from sextant.operators.asof import asof_join

    w = Window.partitionBy(*keys).orderBy("vintage_date").rangeBetween(Window.unboundedPreceding, 0)
    running = known(vintages).withColumn("_best", F.max(F.struct("obs_date", "vintage_date", "value")).over(w)).select(*keys, F.col("vintage_date").alias("_known"), F.col("_best.obs_date").alias("obs_date"), F.col("_best.value").alias("value"))
    return asof_join(dates, running.dropDuplicates([*keys, "_known"]), keys=list(keys), left_on=date, right_on="_known", values=["obs_date", "value"])


def timely(vintages: DataFrame, keys=KEYS) -> DataFrame:
    """Observations whose first vintage came within max(92, median spacing + 100) days."""
    first = first_vintage(vintages, keys)
    w = Window.partitionBy(*keys).orderBy("obs_date")
    gaps = first.withColumn("_gap", F.datediff("obs_date", F.lag("obs_date").over(w)))
    most = gaps.groupBy(*keys).agg(F.greatest(F.lit(92), F.coalesce(F.median("_gap"), F.lit(0)).cast("int") + 100).alias("_most"))
    good = first.join(most, list(keys)).where(F.datediff("vintage_date", "obs_date") <= F.col("_most")).select(*keys, "obs_date")
    return vintages.join(good, [*keys, "obs_date"], "left_semi")


def revisions(vintages: DataFrame, horizon: int | Column, keys=KEYS) -> DataFrame:
    """Each observation's revision within ``horizon`` days (a number, or a key's column) of its first release: in level, relative to the level, and in growth.

    Growth is against the observation before, as known on the same two days. Two as-of reads of each observation and of the one
    before it: four probes in one union and one window.
    """
    from sextant.operators.asof import asof_join

    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("obs_date")
    first = first_vintage(vintages, keys).select(*keys, "obs_date", F.col("vintage_date").alias("first_release_date"), F.col("value").alias("v0")).withColumn("_before", F.lag("obs_date").over(w))
    first = first.withColumn("knowable_date", F.date_add("first_release_date", horizon))
    asked = first.select(*keys, F.col("obs_date").alias("_for"), "first_release_date", "knowable_date", F.col("_before"), F.explode(F.array(
        F.struct(F.lit("vh").alias("what"), F.col("obs_date").alias("obs_date"), F.col("knowable_date").alias("at")), F.struct(F.lit("p0").alias("what"), F.col("_before").alias("obs_date"), F.col("first_release_date").alias("at")),
        F.struct(F.lit("ph").alias("what"), F.col("_before").alias("obs_date"), F.col("knowable_date").alias("at")))).alias("q")).select(*keys, "_for", "q.*")
    read = asof_join(asked.where("obs_date is not null"), known(vintages).select(*keys, "obs_date", "vintage_date", "value"), keys=[*keys, "obs_date"], left_on="at", right_on="vintage_date", values=["value"])
    wide = read.groupBy(*keys, F.col("_for").alias("obs_date")).agg(*(F.max(F.when(F.col("what") == n, F.col("value"))).alias(n) for n in ("vh", "p0", "ph")))
    out = first.join(wide, [*keys, "obs_date"], "left").withColumn("level_rev", F.col("vh") - F.col("v0"))
    return out.select(*keys, "obs_date", "first_release_date", "knowable_date", "level_rev", ratio("level_rev", F.abs("v0")).alias("rel_level_rev"), ((F.col("vh") - F.col("ph")) - (F.col("v0") - F.col("p0"))).alias("growth_rev"))


def safe_pairs(table: DataFrame, unit: str, keys=KEYS) -> DataFrame:
    """Each revision y with x, the latest earlier observation's whose window had closed by y's first release.

    The latest knowable one by observation order, running over knowable dates, answers nearly all. Where that one is later than
    the observation itself (knowable dates out of order), the earlier observations of the series are looked through.
    """
    from sextant.operators.asof import asof_join

    keys = list(keys)
    rows = table.where(F.col(unit).isNotNull()).select(*keys, "obs_date", "first_release_date", "knowable_date", F.col(unit).alias("y"))
    w = Window.partitionBy(*keys).orderBy("knowable_date").rangeBetween(Window.unboundedPreceding, 0)
    latest = rows.withColumn("_b", F.max(F.struct("obs_date", "y")).over(w)).select(*keys, F.col("knowable_date").alias("_k"), F.col("_b.obs_date").alias("x_obs_date"), F.col("_b.y").alias("x")).dropDuplicates([*keys, "_k"])
    out = asof_join(rows, latest, keys=keys, left_on="first_release_date", right_on="_k", values=["x_obs_date", "x"]).where("x is not null")
    good = out.where("x_obs_date < obs_date").select(*keys, "obs_date", "x", "y", "x_obs_date")
    other = rows.select(*keys, F.col("obs_date").alias("_o"), F.col("knowable_date").alias("_k"), F.col("y").alias("_x"))
    found = out.where("x_obs_date >= obs_date").select(*keys, "obs_date", "first_release_date", "y").join(other, keys).where("_o < obs_date and _k <= first_release_date")
    late = found.groupBy(*keys, "obs_date").agg(F.max_by("_x", "_o").alias("x"), F.first("y").alias("y"), F.max("_o").alias("x_obs_date"))
    return good.unionByName(late)
