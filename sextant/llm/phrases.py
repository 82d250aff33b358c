"""Phrase collocations: phrases of several words that stand together far more often than their parts would by chance.

Partitioned mining: every shard of a task finds all phrases of its own that reach the support lowered in proportion to the shard's share of
the words of their language; a phrase that reaches the whole support must do so in one shard at least. Those that may reach
it with what other shards haven't told are then counted in all shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import byte_words, hashed_array, materialise, mixed, pieces, utf8

#: Words of a phrase at most, occurrences of a candidate at least, phrases of a language that are returned.
MAX_WORDS, SUPPORT, TOP = 5, 100, 2000

#: Bytes of one language that are mined as a shard; a longer text is a shard of its own.
SHARD_BYTES = 24 << 20

#: Bits for each phrase told in the filter that tasks count by, and the logarithm of its bits at most: 32 MB are broadcast, however many there are.
FILTER_BITS, MOST_LOG = 16, 28

#: First bits of a phrase's hash, by which phrases are packed and merged.
SEGMENT_BITS = 8

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BREAK = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(128)] + [False] * 128)
_INSIDE = ~_BREAK & ~np.isin(np.arange(256), [0x20, 0x09])


class Shard:
    """The words of some texts as numbers, and how many words follow each within its piece.

    ``word`` has the number of every word in ``names``, the different words; ``room`` is how many words its piece has from it on, up to
    MAX_WORDS.
    """

    def __init__(self, texts: list[bytes]) -> None:
        found, starts, joined, _ = byte_words([t.translate(_LOWER) for t in texts], _INSIDE)
        coded = found.dictionary_encode()
        self.names, self.word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        n = len(self.word)
        ends = np.maximum.reduceat(_BREAK[joined].view(np.uint8), starts) if n else np.zeros(0, np.uint8)
        if n:
            ends[-1] = 1
        self.room = np.ones(n, np.int8)
        for _ in range(MAX_WORDS - 1):
            self.room[:-1] = np.where(ends[:-1] == 1, 1, np.minimum(MAX_WORDS, self.room[1:] + 1))

    def hashes(self, lang: str) -> np.ndarray:
        """A number for each of the different words, the same in every shard of the language."""
        own = np.uint64(zlib.crc32(lang.encode()))
        return mixed(hashed_array(self.names) + own) if len(self.names) else np.zeros(0, np.uint64)

    def phrases(self, lang: str, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words, a place, the count and the hash of every phrase that is ``wanted`` by its hash and count.

        What is wanted holds two shorter phrases that are, too, so only places where both stand are looked at.
        """
        names = self.hashes(lang)
        codes, hashes = self.word, names
        places = np.arange(len(codes))
        for size in range(1, MAX_WORDS + 1):
            counts = np.bincount(codes, minlength=len(hashes))
            chosen = wanted(hashes, counts)
            some = np.zeros(len(hashes), np.int64)
            some[codes] = places
            yield size, some[chosen], counts[chosen], hashes[chosen]
            left = chosen[codes]
            places, codes = places[left], codes[left]
            follows = np.flatnonzero((np.diff(places) == 1) & (self.room[places[:-1]] > size))
            if size == MAX_WORDS or not len(follows):
                return
            found, at, joined = np.unique(codes[follows] * len(hashes) + codes[follows + 1], return_index=True, return_inverse=True)
            places, codes = places[follows], joined
            hashes = longer(hashes[found // len(hashes)], names[self.word[places[at] + size]])

    def text(self, size: int, places: np.ndarray) -> pa.Array:
        parts = [self.names.take(pa.array(self.word[places + i])) for i in range(size)]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())).cast(pa.string()) if size > 1 else parts[0].cast(pa.string())


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of phrases with one more word."""
    return mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + words)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, Shard]]:
    """The texts of a task by language, as soon as there are enough of one for a shard, then the rest."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in pieces(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= most or sum(sizes.values()) >= 2 * most:
                largest = max(sizes, key=sizes.get)
                sizes.pop(largest)
                yield largest, Shard(held.pop(largest))
    for lang in list(held):
        yield lang, Shard(held.pop(lang))


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, n): words of each language."""
    split = F.split("text", r"[\x20\x09.,;:!?\x0A-\x0D]+")
    # a text that starts or ends with a gap has an empty word there
    n = F.size(split) - (F.element_at(split, 1) == "").cast("int") - ((F.size(split) > 1) & (F.element_at(split, -1) == "")).cast("int")
    return docs.groupBy("lang").agg(F.sum(n.cast("long")).alias("n"))


def _segments(hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the runs of hashes in order that share their first bits."""
    cuts = np.searchsorted(hashes >> np.uint64(64 - SEGMENT_BITS), np.arange((1 << SEGMENT_BITS) + 1, dtype=np.uint64))
    return [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]


def mined(docs: DataFrame, total: dict[str, int], support: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(segment, lang, untold, hashes, counts): the phrases, words too, that a shard has often enough for its share, packed by the first bits of their hashes.

    ``untold`` is how often the shard may have a phrase that it doesn't tell. A row of each shard with segment -1 tells that alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches, shard_bytes):
            least = max(1, -(-support * len(shard.word) // max(1, shared.value[lang])))
            found = [(h, c) for _, _, c, h in shard.phrases(lang, lambda _, counts, least=least: counts >= least)]
            hashes, counts = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            parts = [(-1, b"", b"")] + [(k, hashes[a:b].tobytes(), counts[a:b].tobytes()) for k, a, b in _segments(hashes)]
            segment, packed, counted = zip(*parts, strict=True)
            columns = [pa.array(segment, pa.int32()), pa.array([lang] * len(parts), pa.string()), pa.array([least - 1] * len(parts), pa.int64()), pa.array(packed, pa.binary()), pa.array(counted, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "lang", "untold", "hashes", "counts"])

    return docs.mapInArrow(run, "segment int, lang string, untold long, hashes binary, counts binary")


def _filter(told: DataFrame, support: int) -> np.ndarray:
    """One bit for each phrase told that may have the support in all shards, by the first bits of its hash, in 64-bit words; their number is a power of two.

    A shard that doesn't tell a phrase has it fewer times than its lowered support. What those shards may have of it together is known,
    so phrases that can't come up to the support even with that are no candidates.
    """
    untold = {r.lang: r.n for r in told.where("segment < 0").groupBy("lang").agg(F.sum("untold").alias("n")).collect()}
    most = told.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    log = max(SEGMENT_BITS + 6, min(MOST_LOG, (FILTER_BITS * most // 8).bit_length()))

    def merge(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << (log - SEGMENT_BITS), bool)
        for lang in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], lang))
            hashes, counts = (np.concatenate([np.frombuffer(x, kind) for x in own[c].to_pylist()]) for c, kind in (("hashes", np.uint64), ("counts", np.int64)))
            known = np.repeat(own["untold"].to_numpy(), [len(x) // 8 for x in own["hashes"].to_pylist()])
            kinds, at = np.unique(hashes, return_inverse=True)
            highest = np.bincount(at, counts - known, len(kinds)) + untold[lang]
            bits[((kinds[highest >= support] >> np.uint64(64 - log)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return pa.table({"segment": rows["segment"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = told.where("segment >= 0").groupBy("segment").applyInArrow(merge, "segment int, bits binary").toArrow()
    words = np.zeros((1 << SEGMENT_BITS, 1 << (log - SEGMENT_BITS - 6)), np.uint64)
    for segment, bits in zip(parts["segment"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        words[segment] = np.frombuffer(bits, np.uint64)
    return words.ravel()


def counts(docs: DataFrame, total: dict[str, int], support: int = SUPPORT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, f): every phrase of up to MAX_WORDS words, single words too, that occurs ``support`` times, with how often it does."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(materialise(mined(docs, total, support, shard_bytes)), support))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def wanted(hashes: np.ndarray, _: np.ndarray) -> np.ndarray:
            place = hashes >> np.uint64(65 - (64 * len(bits)).bit_length())
            return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        for lang, shard in _shards(batches, shard_bytes):
            found = [x for x in shard.phrases(lang, wanted) if len(x[1])]
            if not found:
                continue
            hashes, counted = (np.concatenate([x[k] for x in found]) for k in (3, 2))
            order = np.argsort(hashes)
            texts = pa.concat_arrays([shard.text(size, places) for size, places, _, _ in found]).take(pa.array(order))
            parts = _segments(hashes[order])
            offsets = pa.array([a for _, a, _ in parts] + [len(order)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (texts, pa.array(counted[order], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), pa.array([lang] * len(parts), pa.string()), *lists], names=["segment", "lang", "phrases", "counts"])

    def merge(rows: pa.Table) -> pa.Table:
        each = pa.table({"phrase": pc.list_flatten(rows["phrases"]), "f": pc.list_flatten(rows["counts"])}).group_by("phrase").aggregate([("f", "sum")])
        often = each.filter(pc.greater_equal(each["f_sum"], support))
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(often), pa.string()), "phrase": often["phrase"], "f": often["f_sum"]})

    # what isn't a candidate but shares a bit with one is counted in every shard as well, and has too few
    packed = docs.mapInArrow(run, "segment int, lang string, phrases array<string>, counts array<long>")
    return packed.groupBy("lang", "segment").applyInArrow(merge, "lang string, phrase string, f long")


def score() -> Column:
    """floor(1000 * a * n / (l * r)), exactly, for counts of up to 15 digits."""
    return F.expr("(cast(1000 * cast(a as decimal(15, 0)) as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")


def mine(docs: DataFrame, *, lang: str = "lang", text: str = "text", support: int = SUPPORT, percent: int = 100, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank from 1, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. Candidates are phrases of
    two to five words that occur ``support`` times within pieces, overlaps counted. Cutting one in two gives l and r, the counts of its parts,
    and floor(1000 * a * n / (l * r)); the lowest counts, of equal ones that of the shorter first part. A candidate inside a longer one with
    at least ``percent`` of its count goes. Phrases rank by score, then a, then their UTF-8 bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; other columns play no part; without words
    there are no rows. All counts are exact and of all texts; nothing is held by the driver but the number of words of each language and
    a filter of a fixed size. With shards so small that ``support`` times their share is under one, each tells all its phrases: give
    ``support`` in proportion to the texts.
    """
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = materialise(_counted(docs))
    total = {r.lang: r.n for r in words.collect()}
    known = materialise(counts(docs, total, support, shard_bytes).withColumn("w", F.split("phrase", " ")))
    found = known.where(F.size("w") > 1).select("lang", "phrase", "w", F.col("f").alias("a"))
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, size(w) - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(words), "lang")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score().alias("score"), "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # what lies in a longer candidate lies in one that is one word longer, with as high a count
    inside = found.where(F.size("w") > 2).withColumn("phrase", F.explode(F.expr("array(array_join(slice(w, 1, size(w) - 1), ' '), array_join(slice(w, 2, size(w) - 1), ' '))")))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    best = best.join(inside, ["lang", "phrase"], "left").where(F.expr(f"within is null or 100 * within < {int(percent)} * a"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
