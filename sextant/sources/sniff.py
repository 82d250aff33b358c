"""Types of columns that come as text: a vote of the first rows, then typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.columns import clean

#: Rows that vote.
FIRST = 20


def number(column: str) -> Column:
    """The number that a text is, with white space around it; null for any other text, for NaN and infinities."""
    return clean(F.expr(f"try_cast(trim(cast(`{column}` as string)) as double)"))


def numeric_columns(rows: DataFrame, order: list[str] | None = None, first: int = FIRST) -> list[str]:
    """The columns in which no value of the first rows is anything but a number; blank and null say nothing. One job for all columns.

    The first rows are those of the least ``order``, else those that Spark reads first. Of an empty table every column is numeric.
    """
    names = rows.columns
    some = (rows.orderBy(*order) if order else rows).limit(first).select(*(F.col(c).cast("string").alias(c) for c in names))
    against = lambda c: F.count(F.when((F.trim(F.col(c)) != "") & F.expr(f"try_cast(trim(`{c}`) as double)").isNull(), 1))
    votes = some.agg(*(against(c).alias(f"v{k}") for k, c in enumerate(names))).first()
    return [c for c, n in zip(names, votes, strict=True) if not n]


def typed(rows: DataFrame, order: list[str] | None = None, first: int = FIRST) -> DataFrame:
    """``rows`` with the numeric columns as doubles; what of their later values is no number is null. Others stay as they are."""
    numeric = set(numeric_columns(rows, order, first))
    return rows.select(*(number(c).alias(c) if c in numeric and dict(rows.dtypes)[c] == "string" else F.col(c) for c in rows.columns))
