"""Exact duplicates: equal texts by salted digest groups, and the one row of each that stays.

Only DataFrame functions are used. Copies are combined three times, each time by digest and full content: within a task, before its
rows are shuffled; within a salt, so that the copies of one text meet in several tasks; then over the salts, where a text has one row
for each salt at most. What comes out are a digest, the id that stays and a count, and rows find theirs by the digest alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tasks among which the copies of one text are combined first.
SALTS = 64

#: Texts with more than this share of all rows, of which there can't be as many, reach their rows by a broadcast.
HOT_GROUPS = 1000


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, content, keep_id, group_size) of rows (id, digest, content): locally, by salts, then over all."""
    salted = rows.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "content").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.repartition("digest").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Each row's id with keep_id, the largest id of the rows of equal text, group_size, their number, kept, whether it is that row, and digest.

    Texts are equal if they are identical after A-Z are lower-cased; null counts as empty. Rows are counted as they come: repeated
    rows of one id and text count each, and are each kept if their id is the largest. A row without an id stays only where no
    row of its text has one. Other columns of ``docs``, whatever their names, play no part. An empty table gives an empty table.

    Contents are compared in full wherever rows are combined. That a digest belongs to one content, which lets rows find their group
    by the digest alone, is counted and not assumed: of a digest with several contents the rows are matched by content as well.
    """
    rows = docs.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("content")).withColumn("digest", digest(F.col("content")))
    found = materialise(_combined(rows).groupBy("digest").agg(F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    shared = found.where("contents > 1").select("digest")
    if shared.isEmpty():
        return _assigned(rows.select("id", "digest"), found.drop("contents"), ["digest"])
    apart = _assigned(rows.select("id", "digest").join(shared, "digest", "left_anti"), found.where("contents = 1").drop("contents"), ["digest"])
    several = rows.join(shared, "digest", "left_semi").select("id", "digest", "content")
    return apart.unionByName(_assigned(several, materialise(_combined(several)), ["digest", "content"]))


def _assigned(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows with what is known of their group: of very large groups by a broadcast, of others of two rows or more by a shuffle."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") > total / HOT_GROUPS
    several = groups.where("group_size > 1")
    hot = several.where(large).withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})
    rows = rows.join(F.broadcast(hot), by, "left")
    # rows of hot groups have nothing to meet any more, and are spread
    rows = rows.withColumn("met", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("id", F.spark_partition_id()))))
    cold = several.where(~large).withColumnRenamed("digest", "met")
    met = rows.join(cold, ["met", *by[1:]], "left")
    keep = F.when(F.col("hot_size").isNotNull(), F.col("hot_id")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    out = met.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("hot_size", "group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that find() keeps, and rows without an id."""
    gone = find(docs, doc_id=doc_id, text=text).where("not kept and doc_id is not null").select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns of what find() found."""
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
