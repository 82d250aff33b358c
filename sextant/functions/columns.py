"""Column expressions used all over: guarded division, moments over complete pairs, clean numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: ColumnLike) -> Column:
    """Null for NaN and infinities: null is the only missing value in the engine."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """Null where the divisor is zero, whatever the session's ANSI setting is."""
    return F.try_divide(col(a), col(b))


def both(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column]:
    """The pair where it is complete, else two nulls."""
    a, b = col(a), col(b)
    whole = a.isNotNull() & b.isNotNull()
    return F.when(whole, a), F.when(whole, b)


def pearson(a: ColumnLike, b: ColumnLike, where: Column | None = None, over: WindowSpec | None = None, least: int = 3) -> Column:
    """Pearson's correlation over complete pairs, by moments: null for constants and for fewer than ``least`` pairs."""
    a, b = both(a, b)
    if where is not None:
        a, b = F.when(where, a), F.when(where, b)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b), F.count(a)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    cov, sa, sb, n = parts
    return F.when(n >= least, ratio(cov, sa * sb))


def average_rank(c: ColumnLike, by: list[ColumnLike]) -> Column:
    """Rank among the non-null values of a group, ties sharing their mean rank."""
    from pyspark.sql import Window

    c, by = col(c), [col(b) for b in by]
    order, ties = Window.partitionBy(*by, c.isNull()).orderBy(c), Window.partitionBy(*by, c)
    return F.when(c.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def tidy(c: ColumnLike, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)
