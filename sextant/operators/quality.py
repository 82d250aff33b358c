"""Audits of tables whose fields are all text, and families of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.columns import ratio
from sextant.sources.sniff import number, numeric_columns


def missing_by_field(rows: DataFrame, most: float = 0.2) -> DataFrame:
    """field, n, missing, share, flagged; null and blank count."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(empty(c), 1)).alias(f"m_{c}") for c in rows.columns))
    got = counts.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"m_{c}").alias("missing")) for c in rows.columns))).alias("x")).select("x.field", "n", "x.missing")
    return got.withColumn("share", F.coalesce(ratio("missing", "n"), F.lit(0.0))).withColumn("flagged", F.col("share") > most)


def outliers_by_field(rows: DataFrame, key: str, fields: list[str], z: float = 4.0, least: int = 4) -> DataFrame:
    """Rows (key, field, value, z) beyond ``z`` sample deviations; what is no number is left out, and so are fields of fewer than ``least``."""
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), number(c).alias("v")) for c in fields))).alias("x")).select(key, "x.field", F.col("x.v").alias("value")).where("value is not null")
    stats = long.groupBy("field").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return long.join(F.broadcast(stats), "field").withColumn("z", ratio(F.col("value") - F.col("_m"), "_s")).where((F.col("_n") >= least) & (F.abs("z") > z)).select(key, "field", "value", "z")


def audit(rows: DataFrame, key: str, order: list[str] | None = None, z: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """missing_by_field of all fields, and outliers_by_field of those that the first rows show to be numbers, but for the key."""
    numeric = [c for c in numeric_columns(rows, order) if c != key]
    none = rows.sparkSession.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, field string, value double, z double")
    return missing_by_field(rows), outliers_by_field(rows, key, numeric, z) if numeric else none


def source_warnings(name: str) -> list[str]:
    """What a source's name hints at: values known only later, and names that are there only because they lasted."""
    name = name.lower()
    return [w for w, marks in (("look-ahead", ("revised", "final", "restated", "adjusted")), ("survivorship", ("current", "constituents", "sp500", "active"))) if any(m in name for m in marks)]


def family_matrix(pairs: DataFrame, lags: list[int], train_end: str, alpha: float = 0.05, by: str = "term") -> DataFrame:
    """Correlations by term and lag before and after ``train_end``, with counts."""
    from sextant.functions.columns import pearson

    w = Window.partitionBy(by).orderBy("obs_date")
    wide = pairs.select(by, "obs_date", "t", *(F.lag("p", k).over(w).alias(f"_p{k}") for k in lags))
    moved = wide.select(by, "obs_date", "t", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("p")) for k in lags))).alias("x")).select(by, "obs_date", "t", "x.*")
    early = F.col("obs_date") <= F.lit(train_end).cast("date")
    whole = F.col("p").isNotNull() & F.col("t").isNotNull()
    return moved.groupBy(by, "lag").agg(pearson("p", "t", early).alias("r_train"), pearson("p", "t", ~early).alias("r_test"), F.count(F.when(early & whole, 1)).alias("n_train"), F.count(F.when(~early & whole, 1)).alias("n_test"))


def contradictions(signals: DataFrame, name: str = "signal_id", sign: str = "sign") -> DataFrame:
    """Pairs of a family's signals (tens of rows) and whether they agree in sign."""
    a = signals.select(F.col(name).alias("a"), F.col(sign).alias("sa"), F.lit(1).alias("_one"))
    b = signals.select(F.col(name).alias("b"), F.col(sign).alias("sb"), F.lit(1).alias("_one"))
    return a.join(F.broadcast(b), "_one").where("a < b").select("a", "b", F.when((F.col("sa") == 0) | (F.col("sb") == 0), "neutral").when(F.col("sa") == F.col("sb"), "agree").otherwise("contradict").alias("verdict"))


def tier_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("confidence_cap").agg(F.count(F.lit(1)).alias("n"))
