"""Ranked lexical search: the documents of highest score for each item, by inner products over sparse ball trees.

A document is the vector of its terms' saturated counts, an item that of its terms' weights, the score their inner product, all in
whole numbers. Each task puts its documents, some thousand at a time, into a tree of balls. For every item the tree is searched best
ball first, and a ball whose bound is under the k-th score so far goes with all that is in it; in the leaves scores are exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import WORD_BYTES, byte_words, materialise, pieces, utf8, words

#: Documents of a tree at most, and of a leaf.
TREE_ROWS, LEAF_ROWS = 4096, 8

#: Numbers of a tree's centroids at most: with many terms, trees get fewer documents. Entries of its documents at most.
TREE_CELLS, TREE_ENTRIES = 8 << 20, 4 << 20

#: Groups of terms; a ball has a radius in each.
BANDS = 1024

#: A document in so many is searched first, so that all other trees start with the k-th scores of these.
FIRST = 16

#: Bytes of items that are searched for at once.
BLOCK_BYTES = 1 << 20

#: What squares and sums of doubles are widened by, relative to the largest number in them: far over their rounding.
SLACK = 1e-10

_INSIDE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of documents of ``n`` terms."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 75 + 25 * n * n_docs // n_terms


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class BallTree:
    """Sparse vectors, in order of the leaves, with centroid and radii of every ball.

    ``code`` and ``value`` hold the entries of the rows that ``ptr`` bounds; every row has at least one. ``scale`` is a term's factor
    on both sides of the product, ``band`` its group. A ball's bound for an item q is q times its centroid, and in each
    group the length of q times the radius: no vector within can be further along q. Radii are widened by what rounding can do.
    """

    def __init__(self, ptr: np.ndarray, code: np.ndarray, value: np.ndarray, scale: np.ndarray, band: np.ndarray) -> None:
        self.scale, self.band, terms = scale, band, len(scale)
        rows = len(ptr) - 1
        x = scale[code] * value
        order = np.arange(rows)
        bands = int(band.max()) + 1 if terms else 1
        centre, radius, self.at, self.children = [], [], [], []
        todo = [(0, rows, -1)]
        while todo:
            a, b, parent = todo.pop()
            me = len(self.at)
            if parent >= 0:
                self.children[parent].append(me)
            self.at.append((a, b))
            self.children.append([])
            own = order[a:b]
            take = _ranges(ptr[own], ptr[own + 1])
            c, v, r = code[take], x[take], np.repeat(np.arange(b - a), ptr[own + 1] - ptr[own])
            mean = np.bincount(c, v, terms) / (b - a)
            # squares of the distances of every row in each band: of its entries, and of the centroid's terms that it lacks
            square = np.bincount(band, mean * mean, bands)
            away, mine = v - mean[c], mean[c]
            cell = r * bands + band[c]
            far = np.bincount(cell, away * away - mine * mine, (b - a) * bands).reshape(b - a, bands) + square
            most = np.bincount(cell, v * v, (b - a) * bands).reshape(b - a, bands).max(axis=0)
            centre.append(mean)
            radius.append(np.sqrt(np.maximum(far.max(axis=0), 0) + SLACK * (most + square)))
            if b - a > LEAF_ROWS:
                # the row furthest from the centroid, and that furthest from it, split the rest in halves
                first = int(far.sum(axis=1).argmax())
                pole = np.bincount(c[r == first], v[r == first], terms)
                norms = np.bincount(r, v * v, b - a)
                second = int((norms - 2 * np.bincount(r, v * pole[c], b - a)).argmax())
                along = np.bincount(r, v * (np.bincount(c[r == second], v[r == second], terms) - pole)[c], b - a)
                order[a:b] = own[np.argsort(along, kind="stable")]
                half = (a + b) // 2
                todo += [(half, b, me), (a, half, me)]
        self.centre, self.radius, self.order = np.array(centre), np.array(radius), order
        take = _ranges(ptr[order], ptr[order + 1])
        self.code, self.value = code[take], value[take]
        self.ptr = np.concatenate([[0], np.cumsum(np.diff(ptr)[order])])

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each ball a number that no score in it passes; ``counts`` are the item's."""
        q = self.scale[terms] * counts
        length = np.sqrt(np.bincount(self.band[terms], q * q, self.radius.shape[1]))
        used = np.flatnonzero(length)
        bound = self.centre[:, terms] @ q + self.radius[:, used] @ length[used]
        return bound * (1 + SLACK) + 1

    def search(self, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, best: TopK) -> int:
        """Gives ``best`` the rows that can be among the best for an item; returns how many leaves were scored."""
        bound, scored = self.bounds(terms, counts), 0
        heap = [(-bound[0], 0)]
        exact = np.zeros(len(self.scale), np.int64)
        exact[terms] = weights[terms] * counts
        while heap and -heap[0][0] >= best.least:
            top, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= best.least:
                        heapq.heappush(heap, (max(top, -bound[child]), child))
                continue
            scored += 1
            a, b = self.at[node]
            start, end = self.ptr[a], self.ptr[b]
            scores = np.add.reduceat(exact[self.code[start:end]] * self.value[start:end], self.ptr[a:b] - start)
            best.add(scores, self.order[a:b])
        return scored


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    lengths = ends - starts
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


#: The id of a document without one, in the order of equal scores.
NO_ID = np.iinfo(np.int64).max


class TopK:
    """The k best (score, id) of one item, of equal scores those of small ids; only scores over 0 and from ``least`` on count."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least, self.ids = k, max(1, least), np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        near = scores >= self.least
        if not near.any():
            return
        score, doc = np.concatenate([self.score, scores[near]]), np.concatenate([self.id, self.ids[rows[near]]])
        top = np.lexsort((doc, -score))[: self.k]
        self.score, self.id = score[top], doc[top]
        if len(top) == self.k:
            self.least = max(self.least, int(self.score[-1]))


def _vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, codes, tfs) of the documents with terms: their number, and which of the vocabulary how often."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist()), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for batch in pieces(batches, "text"):
            texts = [t.translate(_LOWER) for t in utf8(batch.column("text"))]
            found, starts, _, heads = byte_words(texts, _INSIDE)
            doc = np.searchsorted(heads, starts, "right") - 1
            n = np.bincount(doc, minlength=len(texts))
            code = pc.index_in(found, known).fill_null(-1).to_numpy()
            cell, tf = np.unique(doc[code >= 0] * size + code[code >= 0], return_counts=True)
            offsets = np.searchsorted(cell, np.arange(len(texts) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in ((cell % max(1, size)).astype(np.int32), tf.astype(np.int32))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "codes", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


def banded(df: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A group for each term: terms by how many documents have them, groups of about equal sums of weights times documents."""
    order = np.argsort(-df, kind="stable")
    mass = np.cumsum((df * weights)[order].astype(np.float64))
    band = np.zeros(len(df), np.int64)
    if len(df) and mass[-1] > 0:
        band[order] = np.minimum(BANDS - 1, mass / mass[-1] * BANDS).astype(np.int64)
    return band


def _found(vectors: DataFrame, items: list[Counter], index: dict[bytes, int], df: np.ndarray, n_docs: int, n_terms: int, k: int, least: list[int]) -> DataFrame:
    """(item, doc_id, score): of each task's documents the k best for each item, from its ``least`` score on."""
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    asked = [(np.array([index[t] for t in item], np.int64), np.array(list(item.values()), np.int64)) for item in items]
    shared = vectors.sparkSession.sparkContext.broadcast((asked, weights, np.sqrt(weights), banded(df, weights), least))
    rows_at_once = max(8 * LEAF_ROWS, min(TREE_ROWS, TREE_CELLS // max(1, len(df)) * LEAF_ROWS // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, scale, band, least = shared.value
        best = [TopK(k, x) for x in least]
        held: list[pa.RecordBatch] = []

        def tree_of(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            codes, tfs = table["codes"].combine_chunks(), table["tfs"].combine_chunks()
            ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy())]).astype(np.int64)
            code, tf = codes.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            m = lengths_norm(table["n"].to_numpy(), n_docs, n_terms)
            tree = BallTree(ptr, code, saturated(tf, np.repeat(m, np.diff(ptr))), scale, band)
            ids = table["doc_id"].fill_null(NO_ID).to_numpy()
            for (terms, counts), top in zip(asked, best, strict=True):
                if len(terms):
                    top.ids = ids
                    tree.search(terms, counts, weights, top)

        rows = entries = 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("codes")), 0))
            while batch.num_rows:
                sizes = np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy())
                n = max(1, min(rows_at_once - rows, int(np.searchsorted(sizes, TREE_ENTRIES - entries, "right"))))
                held.append(batch.slice(0, n))
                rows, entries, batch = rows + n, entries + int(sizes[n - 1]), batch.slice(n)
                if rows >= rows_at_once or batch.num_rows:
                    tree_of(held)
                    held, rows, entries = [], 0, 0
        if held:
            tree_of(held)
        item = np.repeat(np.arange(len(best)), [len(x.id) for x in best])
        ids = np.concatenate([x.id for x in best]) if best else np.zeros(0, np.int64)
        scores = np.concatenate([x.score for x in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "codes", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank: first of every 64th of the ids, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("part", F.pmod("doc_id", F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(total // block_bytes)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r.item_id, bytes(r.text)) for r in part.collect()]


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of highest score over 0 for each item: item_id, rank from 1, doc_id, score.

    Terms are runs of ASCII letters, digits and all beyond ASCII, with A-Z lower-cased. Of equal scores the smaller id ranks higher, documents
    without an id (ids are longs) last. Null and empty texts have no terms: such items have no rows, such documents don't count among
    the documents. Repeated rows are documents, or items, of their own. Other columns play no part; empty tables give an empty table.

    Counts are over all documents, and every document is searched. Items are taken ``block_bytes`` at a time, which bounds what is
    broadcast and held by the driver: their terms, counts and k-th scores.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    out = None
    for block in _blocks(items, block_bytes):
        counted = [Counter(words(t)) for _, t in block]
        vocabulary = sorted(set().union(*counted))
        index = {t: i for i, t in enumerate(vocabulary)}
        vectors = materialise(_vectors(docs, pa.array(vocabulary, pa.binary())))
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
            df[r.code] = r["count"]
        first = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0
        ask, least = (counted, index, df, n_docs, n_terms, k), [0] * len(block)
        some = materialise(_best(_found(vectors.where(first), *ask, least), k))
        for r in some.where(F.col("rank") == k).collect():
            least[r.item] = r.score
        rest = _found(vectors.where(~first), *ask, least)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = _best(some.select("item", "doc_id", "score").union(rest), k)
        best = materialise(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        out = best if out is None else out.union(best)
    return out
