"""The corpus pipeline, stage by stage, and the registry."""

import random

import corpus_pipeline
from sextant.llm import decontaminate, toxicity

from .test_operators import docs_of, prose


def test_stages(spark, tmp_path):
    r = random.Random(5)
    clean = [prose(r, 80) for _ in range(40)]
    bad = [prose(r, 40) + f" zlorp {prose(r, 5)} grunt zlorp" for _ in range(40)]
    item = prose(r, 30)
    near = clean[0].split()
    near[7] += "x"
    texts = clean + bad + [" ".join(near), clean[1], clean[2] + " " + item + " " + prose(r, 60), clean[3] + "\n" + clean[4], None, ""]
    docs = docs_of(spark, texts, extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(40 <= k < 80)) for k in range(80)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, held = docs, {x.doc_id for x in docs.where(toxicity.held_out()).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        rows = {x.doc_id: x for x in kept.collect()}
        if name != "packing":
            assert kept.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            gone = {x.doc_id for x in before.collect()} - rows.keys()
            assert gone <= set(range(40, 80)) and len(gone - held) >= 30 and len(gone & held) >= 0.7 * len(held & set(range(40, 80)))
        if name == "line_dedup":
            assert 81 not in rows and 83 not in rows and rows[84].text is None and set(range(40)) <= rows.keys()
        if name == "near_dedup":
            assert 80 not in rows and set(range(40)) <= rows.keys()
        if name == "decontamination":
            found = decontaminate.match_items(kept, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
            assert found.where("size(starts) > 0").count() == 0 and 82 in rows and rows[82].n_chars == len(rows[82].text) and set(range(40)) <= rows.keys()
        if name == "packing":
            assert set(range(40)) <= rows.keys()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()


def test_long_and_short_items_go_from_one_document(spark):
    """An item shorter than a window goes, too, where a run of a longer item stands elsewhere in the text."""
    r = random.Random(6)
    long, short, a, b, c = (prose(r, n) for n in (20, 6, 15, 15, 15))
    part = " ".join(long.split()[3:15])
    docs = docs_of(spark, [f"{a} {part} {b} {short} {c}"], extra=False)
    items = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).first().text.split() == f"{a} {b} {c}".split()


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def written(spark, tmp_path, texts, labels, items=(), ids=None):
    """Tables in a folder; documents have columns that clash with the operators' own."""
    ids = ids or list(range(len(texts)))
    docs = docs_of(spark, texts, extra=False).selectExpr("doc_id as _k", "* except (doc_id)")
    docs = docs.join(spark.createDataFrame(list(enumerate(ids)), "_k long, doc_id long"), "_k").selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' as score", "7 as n_removed", "'y' as _gone", "1 as starts", "'z' as key")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_stages_on_empty_tables(spark, tmp_path):
    docs = written(spark, tmp_path, [], [])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and (name == "packing" or docs.columns == list(corpus_pipeline.COLUMNS))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_repeated_rows_nulls_and_one_class_of_labels(spark, tmp_path):
    r = random.Random(7)
    text = prose(r, 60)
    texts, ids = [text, text, text, None, None, "", prose(r, 40), prose(r, 30)], [1, 1, 1, 2, None, 3, 4, None]
    docs = written(spark, tmp_path, texts, [(1, 1), (2, 1), (4, 1)], ids=ids)
    count = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        count[name] = sorted((str(x.doc_id) for x in docs.select("doc_id").collect()))
    assert count["toxicity"] == sorted(map(str, ids)) == count["line_dedup"]
    # null and empty texts have no words and are copies of one another; rows without an id stay
    assert count["near_dedup"] == count["decontamination"] == ["1", "2", "4", "None", "None"] and set(count["packing"]) == {"1", "2", "4", "None"}


def test_near_copies_go_by_their_whole_texts(spark, tmp_path):
    """What line dedup leaves of a near copy is unlike the rest, yet goes as a near copy; a document with a line of another's stays."""
    r = random.Random(8)
    lines = [prose(r, 12) for _ in range(10)]
    changed = [*lines[:9], prose(r, 12)]
    own = [prose(r, 12) for _ in range(5)]
    docs = written(spark, tmp_path, ["\n".join(lines), "\n".join(changed), "\n".join([*own, lines[0]])], [])
    left = corpus_pipeline.without_repeated_lines(spark, docs, str(tmp_path))
    assert {x.doc_id: x.text for x in left.collect()} == {0: "\n".join(lines), 1: changed[9], 2: "\n".join(own)}
    other = spark.createDataFrame([(50, changed[9], "en", "x", 1), (51, changed[9] + "!", "en", "x", 1)], left.schema)
    kept = corpus_pipeline.without_near_copies(spark, left.union(other), str(tmp_path))
    assert {x.doc_id: x.text for x in kept.collect()} == {0: "\n".join(lines), 2: "\n".join(own), 50: changed[9]}


def test_near_copies_go_by_the_texts_that_line_dedup_leaves(spark, tmp_path):
    """Of unlike documents that without their repeated lines are near copies one stays, but none goes for a document that goes itself."""
    r = random.Random(9)
    first, second = ([prose(r, 12) for _ in range(12)] for _ in range(2))
    own, other = prose(r, 40), prose(r, 30)
    in_lines = lambda x: "\n".join(" ".join(x.split()[k : k + 10]) for k in range(0, 40, 10)).strip()  # the same words, but none of the lines
    texts = ["\n".join(first), "\n".join(second), "\n".join([*first[:8], own]), "\n".join([*second[:8], in_lines(own)]), "\n".join([*first, other]), in_lines(other)]
    docs = written(spark, tmp_path, texts, [])
    left = corpus_pipeline.without_repeated_lines(spark, docs, str(tmp_path))
    assert {x.doc_id: x.text for x in left.collect()} == {0: texts[0], 1: texts[1], 2: own, 3: in_lines(own), 4: other, 5: texts[5]}
    kept = corpus_pipeline.without_near_copies(spark, left, str(tmp_path))
    assert {x.doc_id: x.text for x in kept.collect()} == {0: texts[0], 1: texts[1], 2: own, 5: texts[5]}
