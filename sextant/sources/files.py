"""Readers of files as long frames: series, vintages, wide tables, folders of series, the catalog, corpora and aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sextant.functions.columns import clean
from sextant.operators.registry import Catalog, all_datasets


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _number(c: str) -> Column:
    return clean(F.expr(f"try_cast(`{c}` as double)"))


def _need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing columns {missing}; there are {df.columns}")


def read_series(spark: SparkSession, path: str, series_id: str, date: str = "date", value: str = "value") -> DataFrame:
    """(series_id, obs_date, value) of a CSV file; KeyError for a column that is not there. Order is for windows to make."""
    df = _csv(spark, path)
    _need(df, date, value)
    return df.select(F.lit(series_id).alias("series_id"), F.to_date(F.col(date)).alias("obs_date"), _number(value).alias("value"))


def read_vintages(spark: SparkSession, path: str, series_id: str, observation: str = "observation_date", vintage: str = "vintage_date", value: str = "value") -> DataFrame:
    df = _csv(spark, path)
    _need(df, observation, vintage, value)
    return df.select(F.lit(series_id).alias("series_id"), F.to_date(F.col(observation)).alias("obs_date"), F.to_date(F.col(vintage)).alias("vintage_date"), _number(value).alias("value"))


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """A table with dates in its first column and a series in each other, as long rows."""
    df = _csv(spark, path)
    return unpivoted(df, df.columns[0])


def unpivoted(df: DataFrame, date: str) -> DataFrame:
    columns = [c for c in df.columns if c != date]
    return df.select(F.to_date(F.col(date)).alias("obs_date"), *(_number(c).alias(c) for c in columns)).unpivot("obs_date", columns, "series_id", "value").select("series_id", "obs_date", "value")


def melt_vintages(df: DataFrame, date: str = "observation_date") -> DataFrame:
    """One column for each vintage, <SERIES>_<YYYYMMDD>, as vintage rows; blanks and single points are no values."""
    columns = [c for c in df.columns if c != date]
    long = df.select(date, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(date, columns, "_name", "_v").where("_v is not null and trim(_v) not in ('', '.')")
    return long.select(F.regexp_extract("_name", r"^(.*)_(\d{8})$", 1).alias("series_id"), F.to_date(F.col(date)).alias("obs_date"), F.to_date(F.regexp_extract("_name", r"_(\d{8})$", 1), "yyyyMMdd").alias("vintage_date"), _number("_v").alias("value"))


def read_folder(spark: SparkSession, pattern: str, columns: dict[str, str], key: str = "ticker") -> DataFrame:
    """Files of one form, each file's name (without its ending) as ``key``."""
    df = _csv(spark, pattern)
    _need(df, *columns)
    cast = {"date": lambda c: F.to_date(F.col(c)), "double": _number, "long": lambda c: F.expr(f"try_cast(`{c}` as bigint)")}
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias(key), *((cast[t](c) if t in cast else F.col(c)).alias(c) for c, t in columns.items()))


def news_panel(volume: DataFrame, tone: DataFrame, key: str = "ticker") -> DataFrame:
    """Article counts with their tone, where there is one."""
    return volume.join(tone, [key, "date"], "left")


def stitched(chunks: list[DataFrame]) -> DataFrame:
    """Chunks of series one after the other; where they overlap, the earlier chunk's row stays."""
    from functools import reduce

    from pyspark.sql import Window

    every = reduce(DataFrame.unionByName, (c.withColumn("_chunk", F.lit(k)) for k, c in enumerate(chunks)))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("series_id", "obs_date").orderBy("_chunk"))).where("_n = 1").drop("_n", "_chunk")


def split_list(c: str, sep: str = ";") -> Column:
    """The trimmed, non-empty parts of a text."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: str) -> Column:
    return F.lower(F.trim(F.col(c))).isin("yes", "true", "1")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Tagged events; texts are trimmed, tags are an array."""
    df = _csv(spark, path)
    tidy = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c != "tags" else split_list("tags").alias("tags") for c in df.columns]
    return df.select(*tidy)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    return df.withColumn("corpus_name", F.lower(F.trim("corpus_name")))


def _table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A catalog's CSV file with these columns; a file that is not there is empty."""
    try:
        df = _csv(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


SOURCE = "id string, name string, domain string, entry_kind string, description string, homepage_url string, docs_url string, type array<string>, auth_required string, cost string, license string, frequency string, lag string, geography array<string>, join_keys array<string>, primary_keys array<string>, agent_use_cases array<string>"


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    """index.json, datasets.csv, fields.csv and join-keys.csv of a folder."""
    sources = spark.read.schema(SOURCE).option("multiLine", True).json(f"{folder}/index.json")
    empty = F.array().cast("array<string>")
    sources = sources.select(*(F.coalesce(c, empty).alias("use_cases" if c == "agent_use_cases" else c) if c in ("type", "geography", "join_keys", "primary_keys", "agent_use_cases") else F.col(c) for c in sources.columns))
    d = _table(spark, f"{folder}/datasets.csv", ["id", "source_id", "name", "entry_kind", "time_index", "time_grain", "primary_keys", "join_keys"]).where("id is not null and id != ''")
    listed = d.select("id", "source_id", F.coalesce("name", "id").alias("name"), "entry_kind", "time_index", *(split_list(c).alias(c) for c in ("time_grain", "primary_keys", "join_keys")), F.lit(True).alias("is_catalog"))
    f = _table(spark, f"{folder}/fields.csv", ["source_id", "dataset_id", "field_name", "type", "role", "join_key", "unit", "required", "description"])
    fields = f.select("source_id", "dataset_id", F.col("field_name").alias("name"), "type", "role", F.when(F.col("join_key") != "", F.col("join_key")).alias("join_key"), "unit", truthy("required").alias("required"), "description", F.monotonically_increasing_id().alias("ordinal"))
    keys = _table(spark, f"{folder}/join-keys.csv", ["join_key", "entity_type", "pattern", "examples", "description"]).withColumn("examples", split_list("examples"))
    return Catalog(sources, all_datasets(sources, listed), fields, keys)
