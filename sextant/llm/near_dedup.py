"""Near-duplicate documents by Order MinHash: sketches of the smallest labelled word runs in text order, verified by banded alignment of the words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import components, hashed_words, hubs, materialise, mixed, pieces, small_side, trimmed, utf8, words

RUN = 5
SIMILARITY = 0.8
#: Sketches by the number of runs a text has: from, below, minima in a sketch, sketches. The ranges overlap by more than 1/SIMILARITY, so
#: two texts that are similar enough have a range in common.
LEVELS = ((4, 18, 1, 10), (11, 60, 2, 20), (40, 1 << 62, 3, 40))
#: Members of a bucket that are compared in one task; larger buckets are dealt in squares of two such parts.
PART = 2_000
#: Counters of a text's words by hash, whose differences bound what two texts have in common.
COUNTERS = 128
_RANDOM = np.random.default_rng(21)
_RUN_POWERS = _RANDOM.integers(1, 1 << 63, RUN, dtype=np.uint64) | np.uint64(1)
_SEEDS = _RANDOM.integers(1, 1 << 63, (2, 40), dtype=np.uint64) | np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def runs_of(hashes: np.ndarray, k: int = RUN) -> np.ndarray:
    """A number for each run of k words; a text of fewer words, but not none, is one run."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    return mixed(sum(hashes[i : n - k + 1 + i] * _RUN_POWERS[i] for i in range(k)) + np.uint64(k))


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs told apart by which occurrence of the same run in the text they are."""
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if len(first) == len(runs):
        return runs
    occurrence = np.empty(len(runs), np.uint64)
    occurrence[order] = np.arange(len(runs)) - np.repeat(first, np.diff(np.concatenate((first, [len(runs)]))))
    return np.where(occurrence > 0, mixed(runs + occurrence * np.uint64(0x9E3779B97F4A7C15)), runs)


def sketches(runs: np.ndarray) -> list[int]:
    """Order MinHash: for each of several orders by hash, the first labelled runs, as they stand in the text."""
    out: list[int] = []
    n = len(runs)
    if n < LEVELS[0][0]:
        return out
    own = labelled(runs)
    for level, (low, high, minima, count) in enumerate(LEVELS):
        if not low <= n < high:
            continue
        v = (own ^ _SEEDS[0][:count, None]) * _SEEDS[1][:count, None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        at = v.argmin(1)[:, None] if minima == 1 else np.sort(np.argpartition(v, minima - 1, 1)[:, :minima], 1)
        keys = mixed((own[at] * _PLACES[:minima]).sum(1) + (np.arange(count) + 64 * level).astype(np.uint64))
        out += keys.view(np.int64).tolist()
    return out


def _sketched(docs: DataFrame, text: str) -> DataFrame:
    """A row for each document: its id, a key of its words (of its text, if that has none), its number of words, its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in pieces(batches, text):
            texts = utf8(batch.column(text))
            split = [words(t) for t in texts]
            keys, counts, found = [], [], []
            for raw, own, hashes in zip(texts, split, hashed_words(split), strict=True):
                key = hashlib.blake2b(b" ".join(own) if own else b"\x00" + raw, digest_size=16).digest()
                keys.append(key)
                counts.append(len(own))
                found.append(sketches(runs_of(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "sketches"])

    return docs.select("doc_id", text).where("doc_id is not null").mapInArrow(run, "doc_id long, key binary, n int, sketches array<long>")


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The longest common subsequence of two lists whose partners stand at most ``most`` places apart: banded alignment, a bit for each place."""
    a, b = a.tolist(), b.tolist()
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_, band = full, (1 << 2 * most + 1) - 1
    for j, x in enumerate(b):
        if hit := where.get(x):
            hit &= band << j - most if j >= most else band >> most - j
            if both := open_ & hit:
                open_ = (open_ + both | open_ - both) & full
    return start + end + len(a) - open_.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned words over all words of two texts, 0 to 1; below ``least`` it may come out lower than it is.

    With c aligned words it is c / (|a| + |b| - c): of the words that a copy and its text have between them, those that edits left
    in place. Texts that have as many of their runs of five words in the same order have at least as many of their words. At ``least`` or more,
    partners are no further apart than the words that have none.
    """
    n = len(a) + len(b)
    if not n or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    bound = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    if bound < least * (n - bound):
        return 0.0
    c = aligned(a, b, int(n * (1 - least) / (1 + least)) + 1)
    return c / (n - c)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("hashes").alias("of_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("hashes").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True):
                keep.append(similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _word_numbers(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """A 32-bit number for each word of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in pieces(batches, text):
            found = [(h >> np.uint64(32)).astype(np.uint32).tobytes() for h in hashed_words([words(t) for t in utf8(batch.column(text))])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "hashes"])

    return docs.select("doc_id", text).join(small_side(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes binary").dropDuplicates(["doc_id"])


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connecting(group: np.ndarray, doc: np.ndarray, root: np.ndarray, numbers: list[np.ndarray], least: float, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs within groups connect, beyond documents of one ``root``: fewer than there are rows.

    Rows are in the order of their groups; with ``part``, pairs are of different parts. Each row of a group meets all later ones, but
    not those it is connected with by then, nor those that lengths or counts of words rule out.
    """
    ids, first, node = np.unique(doc, return_index=True, return_inverse=True)
    _, one, of = np.unique(root[first], return_index=True, return_inverse=True)
    parent = one[of].tolist()
    top_of = np.array(parent)
    size = np.array([len(numbers[k]) for k in first.tolist()])
    counts = np.stack([np.bincount(numbers[k] % COUNTERS, minlength=COUNTERS) for k in first.tolist()]).astype(np.int32)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fresh = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(fresh, len(group)))
    begin = np.repeat(fresh, sizes)
    rank = np.arange(len(group)) - begin
    found: list[tuple[int, int]] = []
    tested: set[tuple[int, int]] = set()
    rows, p = np.arange(len(group)), 0
    while True:
        rows = rows[rank[rows] > p]
        if not len(rows):
            return found
        pivot = begin[rows] + p
        x, y = node[pivot], node[rows]
        ok = (top_of[x] != top_of[y]) & (np.minimum(size[x], size[y]) >= least * np.maximum(size[x], size[y]))
        if part is not None:
            ok &= part[pivot] != part[rows]
        x, y, before = x[ok], y[ok], len(found)
        for at in range(0, len(x), 4096):
            u, v = x[at : at + 4096], y[at : at + 4096]
            both = size[u] + size[v]
            common = (both - np.abs(counts[u] - counts[v]).sum(1)) // 2  # words in common at most
            near = common >= least * (both - common)
            for a, b in zip(u[near].tolist(), v[near].tolist(), strict=True):
                pair = (a, b) if a < b else (b, a)
                if pair in tested or (ra := top(a)) == (rb := top(b)):
                    continue
                tested.add(pair)
                if similarity(numbers[first[a]], numbers[first[b]], least) >= least:
                    parent[ra] = rb
                    found.append((int(ids[a]), int(ids[b])))
        p += 1
        if len(found) > before:
            top_of = np.array([top(k) for k in range(len(parent))])


def _connected(rows: DataFrame, numbers: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that connect what similar pairs of a common bucket connect, beyond rows of one ``root``. Buckets of more than PART rows are dealt in squares of two parts."""
    dealt = rows.withColumn("parts", F.ceil(F.col("size") / PART)).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    names = ("bucket", "low", "high", "doc_id", "root", "part", "hashes")
    dealt = dealt.select("bucket", "doc_id", "root", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).join(numbers, "doc_id").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            group, low, high, doc, root, part = (table.column(c).to_numpy() for c in ("group", *names[1:6]))
            words_of = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
            for crossed in (False, True):
                own = np.flatnonzero((low != high) == crossed)
                if len(own):
                    pairs = connecting(group[own], doc[own], root[own], [words_of[k] for k in own.tolist()], least, part[own] if crossed else None)
                    yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in pairs], pa.int64()), pa.array([max(x) for x in pairs], pa.int64())], names=["a", "b"])

        def grouped(table: pa.Table) -> tuple[pa.Table, int]:
            """The table with a number for each square, and where the last one begins."""
            keys = [table.column(c).to_numpy() for c in names[:3]]
            fresh = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            return table.append_column("group", pa.array(np.cumsum(fresh))), int(np.flatnonzero(fresh)[-1])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= PART or sum(x.nbytes for x in held) >= HELD_BYTES:
                table, last = grouped(pa.Table.from_batches(held))
                if last:
                    yield from done(table.slice(0, last))
                    held = table.slice(last).drop_columns(["group"]).combine_chunks().to_batches()
        if held:
            yield from done(grouped(pa.Table.from_batches(held))[0])

    return dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "doc_id").mapInArrow(run, "a long, b long")


#: Bytes of words that a task holds at once; one bucket, or square of a larger one, is held whole.
HELD_BYTES = 32 << 20


def classes(docs: DataFrame, *, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row for each document id: its class, named by the smallest id in it.

    Texts of the same words, or without words the same text (null is empty), are copies, and one of them stands for all. Texts
    that share a sketch are candidates. Each is first compared with the bucket's centre, the member that shares most sketches with
    others; then all pairs of a bucket that this hasn't connected are, whatever its size. Linked are pairs with an aligned
    similarity (see similarity) of ``least`` or more; classes are connected components of the links. Buckets of more than PART members are
    dealt to several tasks. Ids are longs; rows without one are in no class, and rows of one id with different texts are a row
    each. An empty table has no classes. Other columns are not used.
    """
    sketched = materialise(_sketched(docs, text))
    copies = materialise(sketched.groupBy("key").agg(F.min("doc_id").alias("rep")))
    members = sketched.select("doc_id", "key").distinct().join(copies, "key").select("doc_id", "rep")
    reps = sketched.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    listed = reps.where(F.size("sketches") > 0).select("doc_id", "n", F.explode("sketches").alias("bucket"))
    sizes = listed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialise(listed.join(sizes, "bucket"))
    score = shared.groupBy("doc_id").agg(F.sum("size").alias("score"))
    centres = shared.join(score, "doc_id").groupBy("bucket").agg(F.max_by(F.struct("doc_id", "n"), F.struct("score", -F.col("doc_id"))).alias("c"))
    near = F.least("n", "c.n") >= F.lit(least) * F.greatest("n", "c.n")
    pairs = shared.join(centres, "bucket").where(near & (F.col("doc_id") != F.col("c.doc_id"))).select(*_ordered(F.col("doc_id"), F.col("c.doc_id"))).distinct()
    numbers = materialise(_word_numbers(docs, materialise(shared.select("doc_id").distinct()), text))
    links = materialise(_verified(pairs, numbers, least))
    rooted = materialise(shared.join(hubs(links).withColumnRenamed("key", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    roots = components(links.union(_connected(rooted.join(open_, "bucket", "left_semi"), numbers, least)))
    return members.join(roots, members.rep == roots.node, "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))


def deduplicate(docs: DataFrame, *, text: str = "text", least: float = SIMILARITY, judged: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id, and of repeated rows of an id one, that with the smallest text.

    ``judged`` (doc_id, text) has other texts of the same ids, by which classes are found. Rows without an id stay. Of the rest
    only ids are shuffled, and the rows of ids that are there several times.
    """
    found = classes(docs if judged is None else judged, text=text, least=least)
    gone = materialise(found.where("doc_id != class_id").select("doc_id").distinct())
    kept = docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    nth = "_nth" + "_" * max(map(len, docs.columns))  # no column of docs
    again = kept.join(small_side(repeated), "doc_id", "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(text).asc_nulls_first())))
    return kept.join(small_side(repeated), "doc_id", "left_anti").select(*docs.columns).union(again.where(F.col(nth) == 1).select(*docs.columns))
