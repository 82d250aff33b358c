"""The corpus pipeline: documents without toxic ones, repeated lines, near copies and benchmark passages, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents`` and no others,
whatever else comes with them. run() writes each stage's rows to the shared folder before the next reads them. An empty table goes
through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from sextant.llm.common import materialise, small_side, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length that the text has now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model learned from the labelled ones that are not held out.

    Null and empty texts are scored as a text without words. Without labels, or with labels of one kind only, nothing tells toxic
    texts apart and all stay. Repeated rows are each judged alike.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first occurrence of each line; those of which no line is left go.

    Null and empty texts and rows without an id stay as they are; repeated rows of an id lose the same lines.
    """
    done = line_dedup.deduplicate(docs.select(*COLUMNS))
    return _documents(done.where("n_removed < n_lines or n_removed = 0"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id, and one row of each id.

    Judged are, one after the other, the whole texts in ``documents`` and the texts that the stage before has left. Of a near copy
    that stage has left the lines in which it was changed, which tell nothing of what it is a copy of: such go by their whole texts.
    Of the documents that stay, those go whose texts have become near copies, as those of unlike documents can once their repeated
    lines are gone. That comes second, so that no document goes for one that goes itself. Ids that aren't in ``documents`` are
    judged by the text that they have. Empty texts are copies of one another, null ones too; rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    whole = table(spark, sf_dir, "documents", "doc_id", "text")
    kept = materialise(docs.where("doc_id is not null").select("doc_id").distinct())
    known = materialise(whole.where("doc_id is not null").select("doc_id").distinct())
    whole = whole.join(small_side(kept), "doc_id", "left_semi").select("doc_id", "text")
    new = materialise(kept.join(known, "doc_id", "left_anti"))
    if not new.isEmpty():
        whole = whole.union(docs.join(small_side(new), "doc_id", "left_semi").select("doc_id", "text"))
    return near_dedup.deduplicate(materialise(near_dedup.deduplicate(docs, judged=whole)))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items in them; those that are mostly such passages go.

    Null and empty texts stay, and so does everything where there are no items. Each row is judged by itself.
    """
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return _documents(decontaminate.decontaminate(docs.select(*COLUMNS), items))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its place in a sequence. Null and empty texts are the end mark alone."""
    return packing.pack(docs)


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]

#: No stage but the fourth is a query of SQL; each is held against a brute-force version or held-out labels in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
