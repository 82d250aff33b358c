"""Typed columns by the first rows, digests and locks of tables, and the modes of analyses that take all columns."""

import pytest
from pyspark.sql import functions as F

from sextant.operators import locks, quality
from sextant.plans import study
from sextant.sources import sniff


def test_columns_are_numbers_by_their_first_rows(spark):
    rows = [(k, str(k), " 1.5 " if k else "", "x" if k == 30 else "2", "NaN" if k == 25 else "3", "y", None) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, a string, b string, late string, nan string, text string, nothing string").repartition(4)
    assert sniff.numeric_columns(df, ["id"]) == ["id", "a", "b", "late", "nan", "nothing"] and "late" not in sniff.numeric_columns(df, ["id"], first=31)
    got = sniff.typed(df, ["id"])
    assert dict(got.dtypes) == {"id": "int", "a": "double", "b": "double", "late": "double", "nan": "double", "text": "string", "nothing": "double"}
    assert [r.id for r in got.where("late is null").collect()] == [30] and [r.id for r in got.where("nan is null").collect()] == [25] and [r.id for r in got.where("b is null").collect()] == [0]
    assert sniff.numeric_columns(df.limit(0)) == df.columns
    missing, far = quality.audit(df.withColumn("a", F.when(F.col("id") == 7, "9999").otherwise(F.col("a"))), "id", ["id"])
    assert [(r.id, r.field) for r in far.collect()] == [(7, "a")] and {r.field: r.missing for r in missing.collect()}["nothing"] == 40
    assert quality.audit(df.select("id", "text"), "id", ["id"])[1].collect() == []


def test_digests_and_locks(spark):
    rows = [(k, "a|b" if k % 2 else None, float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "id int, name string, v double")
    same = df.orderBy(F.desc("id")).repartition(3).select("v", "name", "id")
    assert locks.snapshot({"t": df}) == locks.snapshot({"t": same}) and locks.snapshot({"t": df}) != locks.snapshot({"t": df.union(df.limit(1))})
    apart = [spark.createDataFrame([x], "a string, b string") for x in (("x", "y|z"), ("x|y", "z"), ("", None), (None, ""), ("-", None))]
    assert len({tuple(locks.digest(x).first()) for x in apart}) == 5 and tuple(locks.digest(df.limit(0)).first()) == (0, 0, 0)
    new = df.where("id != 3").withColumn("v", F.when(F.col("id") == 5, 0.0).otherwise(F.col("v"))).union(spark.createDataFrame([(99, "n", 1.0)], df.schema))
    assert {r.id: r.change for r in locks.changes(df, new, "id").collect()} == {3: "removed", 5: "changed", 99: "added"} and locks.changes(df, same, "id").count() == 0
    held = locks.lock({"t": df}, commit="abc")
    assert locks.lock({"t": same}, held["tables"], commit="abc") == held and held["tables"]["t"]["rows"] == 20
    for tables, options in (({"t": new}, {"known": held["tables"]}), ({"t": df, "u": df}, {"known": held["tables"]}), ({"t": df}, {"dirty": True}), ({"t": df}, {"needs_commit": True})):
        with pytest.raises(locks.ChangedError):
            locks.lock(tables, **options)


def test_modes_of_all_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("date,a,b,c\n" + "\n".join(f"2020-01-{k:02d},{k},{2 * k + k % 3},{k * k % 7}" for k in range(1, 31)))
    df = study.read_table(spark, str(path))
    assert len(study.analyse(df, "correlations")) == 9 and {r["component"] for r in study.analyse(df, "components")} == {1, 2, 3}
    assert [(r["a"], r["b"]) for r in study.analyse(df, "pairs")] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert set(study.analyse(df, "quality")) == {"missing", "outliers"}
