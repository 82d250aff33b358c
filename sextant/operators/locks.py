"""Snapshots of tables: digests of their contents that don't depend on the order of rows, comparisons, and locks that refuse what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ChangedError(ValueError):
    """A table that isn't as it was when it was locked."""


def row_digest(columns: list[str]) -> Column:
    """MD5 of a row: its columns in order of their names, each as its length and text, null apart from every text."""
    said = (F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(columns))
    return F.md5(F.concat_ws("|", *said).cast("binary"))


def digest(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (n, low, high): the number of rows, and sums of two parts of their digests; the same for the same rows in any order."""
    part = lambda a: F.sum(F.conv(F.substring("_d", a, 8), 16, 10).cast("decimal(38,0)"))
    held = rows.select(row_digest(columns or rows.columns).alias("_d"))
    return held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(part(1), F.lit(0)).cast("decimal(38,0)").alias("low"), F.coalesce(part(9), F.lit(0)).cast("decimal(38,0)").alias("high"))


def snapshot(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """By table: its columns, number of rows and digest, as plain values that YAML can hold."""
    out = {}
    for name, rows in sorted(tables.items()):
        r = digest(rows).first()
        out[name] = {"columns": sorted(rows.columns), "rows": int(r.n), "digest": f"{int(r.low):x}-{int(r.high):x}"}
    return out


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): rows that are ``added``, ``removed`` or ``changed``, told by ``key``; by their columns in common. Rows of one key are compared as a set."""
    shared = [c for c in old.columns if c in new.columns]
    side = lambda rows, n: rows.select(F.col(key), row_digest(shared).alias("_d")).groupBy(key).agg(F.array_sort(F.collect_list("_d")).alias(n))
    both = side(old, "_old").join(side(new, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def lock(tables: dict[str, DataFrame], known: dict[str, dict] | None = None, commit: str | None = None, dirty: bool = False, needs_commit: bool = False) -> dict:
    """What a run records of the tables that it reads. Refused where a commit is needed and there is none, where what it names isn't what is there
    (``dirty``), and where tables differ from those ``known`` from an earlier lock."""
    if needs_commit and not commit:
        raise ChangedError("a commit of the catalog is needed, and there is none")
    if dirty:
        raise ChangedError("the catalog has changes that its commit hasn't")
    now = snapshot(tables)
    if known is not None and (differ := sorted(n for n in {*now, *known} if now.get(n) != known.get(n))):
        raise ChangedError(f"not as they were locked: {', '.join(differ)}")
    return {"commit": commit, "tables": now}
