"""Suffix-array deduplication: bytes covered by long strings that also start earlier, found shard by shard.

Sampled places (anchors) that the bytes around them decide bring equal strings together: the strings around one anchor are a context. Each
batch of texts is a shard of its own, whose array settles what repeats within it. Contexts of anchors that several batches have are dealt
to shards by anchor, each with a suffix array; what an anchor spread over several shards has left is merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import materialise, mixed, parted, pieces, utf8

LENGTH = 100
#: Bytes of an anchor, and how many starts of one each string of LENGTH bytes has: the anchor with the least hash stands for the string.
GRAM = 32
CHOICE = LENGTH - GRAM + 1
#: Bytes that are looked at together; a longer text is taken in parts.
PART = 1 << 20
#: Bytes of a shard's array; occurrences of an anchor that are dealt to several shards if there are more.
SHARD = 3 << 20
SPLIT = 20_000
#: Places that are gone through one after the other by common_prefixes.
STRETCH = 512
#: Starts that one number has room for, beside the offset of the first.
MOST = (1 << 24) - 1
_RANDOM = np.random.default_rng(17)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _RANDOM.integers(1, 1 << 63, (8, 2), dtype=np.uint64) | np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)


def _longer(h: np.ndarray, by: int, k: int) -> np.ndarray:
    """Hashes of strings from those of their two parts, ``by`` bytes apart."""
    out = h[:-by] * _STEP[k][0]
    out += h[by:] * _STEP[k][1]
    out ^= out >> np.uint64(31)
    return out


def _parts(docs: list[int], texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Buffers of about PART bytes: (document, offset of its part, number of starts in it), the parts one after the other with all their bytes."""
    spots: list[tuple[int, int, int]] = []
    held: list[bytes] = []
    size = 0
    for doc, text in zip(docs, texts, strict=True):
        for at in range(0, len(text) - LENGTH + 1, PART):
            n = min(PART, len(text) - LENGTH + 1 - at)
            spots.append((doc, at, n))
            held.append(text[at : at + n + LENGTH - 1])
            size += len(held[-1])
            if size >= PART:
                yield spots, b"".join(held)
                spots, held, size = [], [], 0
    if spots:
        yield spots, b"".join(held)


def anchors(spots: list[tuple[int, int, int]], buffer: bytes) -> tuple[np.ndarray, ...]:
    """For each stretch of starts with one anchor: its hash, the hash of all bytes of its strings, document, offset, number of starts."""
    h = _BYTE[np.frombuffer(buffer, np.uint8)]
    for k, by in enumerate((1, 2, 4, 8, 16)):
        h = _longer(h, by, k)
    long = _longer(h, 32, 5)
    least = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    for by in (1, 2, 4, 8, 16, 32, CHOICE - 64):
        least = np.minimum(least[:-by], least[by:])
    sizes = np.array([n for _, _, n in spots])
    begin = np.cumsum(sizes + LENGTH - 1) - (sizes + LENGTH - 1)
    part = np.repeat(np.arange(len(spots)), sizes)
    start = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)
    anchor = (least[start] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
    count = np.diff(np.concatenate((first, [len(part)])))
    low = start[first]
    last = low + count - 1 + LENGTH - 64
    own = mixed(long[low] ^ mixed(long[(low + last) // 2] ^ mixed(long[last] + count.astype(np.uint64) * np.uint64(1000) + (anchor[first] - low).astype(np.uint64))))
    doc = np.array([d for d, _, _ in spots], np.int64)[part[first]]
    offset = low - begin[part[first]] + np.array([a for _, a, _ in spots], np.int64)[part[first]]
    return mixed(h[anchor[first]]).view(np.int64), own.view(np.int64), doc, offset, count


def _stretches(doc: np.ndarray, offset: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same starts in as few stretches as there can be: neighbours joined. Sorted by document and offset."""
    order = np.lexsort((offset, doc))
    doc, offset, count = doc[order], offset[order], count[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (offset[1:] != offset[:-1] + count[:-1]))) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    return doc[first], offset[first], np.add.reduceat(count, first) if len(first) else count


def _spots(offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Offset and number of starts, of at most MOST, as one number."""
    return offset << 24 | count


def _packed(doc: np.ndarray, offset: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and spots of stretches, those of over MOST starts in parts."""
    n = -(-count // MOST)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(doc, n), _spots(np.repeat(offset, n) + part * MOST, np.minimum(np.repeat(count, n) - part * MOST, MOST))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


FOUND = "anchor long, own long, doc_id long, spot long, known boolean"


def _settled(texts: dict[int, bytes], anchor: np.ndarray, lead: np.ndarray, text: np.ndarray, doc: np.ndarray, offset: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rows, in the order of anchor, context, document and offset, the stretches of starts that repeat others of the batch.

    ``lead`` are the first rows of their contexts, whose bytes go to an array; the other rows have the strings of their lead.
    """
    first = np.flatnonzero(_fresh(anchor))
    many = np.repeat(np.diff(np.append(first, len(anchor))) > 1, np.diff(np.append(first, len(anchor))))
    own = np.flatnonzero(many & lead)
    ends = np.cumsum(count[own] + LENGTH - 1)
    out = [[], [], []]
    at = 0
    while at < len(own):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD, side="right"))
        upto = max(at + 1, upto)
        while upto < len(own) and anchor[own[upto]] == anchor[own[upto - 1]]:
            upto += 1
        some = own[at:upto]
        cut = [texts[t][o : o + c + LENGTH - 1] for t, o, c in zip(text[some].tolist(), offset[some].tolist(), count[some].tolist(), strict=True)]
        context, place, earliest = shard_repeats(cut, count[some], doc[some], offset[some])
        start = offset[some][context] + place
        later = (doc[some][context] != doc[some][context[earliest]]) | (start != start[earliest])
        for x, y in zip(out, (doc[some][context[later]], start[later], np.ones(int(later.sum()), np.int64)), strict=True):
            x.append(y)
        at = upto
    leader = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    rest = ~lead & ((doc != doc[leader]) | (offset != offset[leader]))  # the others are of repeated rows of the lead's document
    return _stretches(*(np.concatenate([*x, y[rest]]) for x, y in zip(out, (doc, offset, count), strict=True)))


def _anchored(docs: DataFrame, text: str) -> DataFrame:
    """Rows of contexts, each once for a batch, and stretches of starts that repeat something earlier in the same batch (known).

    ``spot`` has the offset of the first start, and in its low 24 bits the number of starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            ids = batch.column("doc_id").to_pylist()
            texts = utf8(batch.column(text))
            order = sorted(range(len(ids)), key=lambda k: (ids[k], k))
            made = [anchors(*x) for x in _parts(order, [texts[k] for k in order])]
            if not made:
                continue
            anchor, own, which, offset, count = (np.concatenate([m[k] for m in made]) for k in range(5))
            doc = np.array(ids, np.int64)[which]
            order = np.lexsort((offset, doc, own, anchor))
            anchor, own, which, doc, offset, count = (x[order] for x in (anchor, own, which, doc, offset, count))
            lead = _fresh(anchor, own)
            d, spot = _packed(*_settled(texts, anchor, lead, which, doc, offset, count))
            n, m = int(lead.sum()), len(d)
            columns = [np.concatenate((anchor[lead], mixed((d * 31 + spot).astype(np.uint64)).view(np.int64))), np.concatenate((own[lead], np.zeros(m, np.int64))), np.concatenate((doc[lead], d)), np.concatenate((_spots(offset, count)[lead], spot)), np.arange(n + m) >= n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "own", "doc_id", "spot", "known"])

    return docs.select("doc_id", text).where(F.col("doc_id").isNotNull() & (F.octet_length(text) >= LENGTH)).mapInArrow(run, FOUND)


REPEATED = "anchor long, own long, doc_id long, spot long, part long, split boolean, lead boolean"


def _repeated(found: DataFrame, split: int) -> DataFrame:
    """The rows of anchors that several rows have, in parts of ``split`` rows; ``lead`` are the first of their contexts in a part, ``split`` are rows of anchors in parts.

    Known stretches are there, too, without an anchor. A partition is gone through in the order of anchors, and at most ``split``
    rows of one are held.
    """
    names = ("anchor", "own", "doc_id", "spot", "known")

    def out(rows: list[np.ndarray], part: np.ndarray, parted: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        anchor, own, doc, spot, known = rows
        lead = (fresh | _fresh(anchor, own)) & ~known
        return pa.RecordBatch.from_arrays([pa.array(anchor, mask=known), pa.array(own), pa.array(doc), pa.array(spot), pa.array(part), pa.array(parted), pa.array(lead)], names=["anchor", "own", "doc_id", "spot", "part", "split", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, 0  # rows of the last anchor, and how many parts of it are done

        def done(rows: list[np.ndarray], parts: int) -> pa.RecordBatch:
            """Whole anchors, of the first the rest."""
            fresh = _fresh(rows[0])
            first = np.flatnonzero(fresh)
            sizes = np.diff(np.append(first, len(fresh)))
            place = np.arange(len(fresh)) - np.repeat(first, sizes)
            part = place // split
            part[: sizes[0]] += parts
            parted = np.repeat(sizes > split, sizes)
            parted[: sizes[0]] |= parts > 0
            keep = np.repeat(sizes > 1, sizes) | parted | rows[4]
            return out([c[keep] for c in rows], part[keep], parted[keep], (place % split == 0)[keep])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            rows = [c[_fresh(*rows[:4])] for c in rows]
            if not len(rows[0]):
                continue
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            if start:
                yield done([c[:start] for c in rows], parts)
                parts = 0
            held = [c[start:] for c in rows]
            while len(held[0]) > split + 1:  # a row more stays, so that a repetition of it is seen
                yield out([c[:split] for c in held], np.full(split, parts, np.int64), np.ones(split, bool), np.arange(split) == 0)
                held, parts = [c[split:] for c in held], parts + 1
        if held is not None and len(held[0]):
            yield done(held, parts)

    return found.repartition("anchor").sortWithinPartitions("anchor", "own", "doc_id", "spot").select(*names).mapInArrow(run, REPEATED)


# Suffix arrays.


def suffix_array(buffer: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next ``depth`` bytes or more, and each position's rank; equal ones have equal ranks.

    Larsson and Sadakane's refinement: groups of suffixes that agree in h bytes are ordered by the groups their continuations h bytes
    on are in, which doubles h; groups of one are left alone.
    """
    n = len(buffer)
    wide = np.concatenate((buffer, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | wide[k : k + n]
    order = np.argsort(key).astype(np.int32)
    ordered = key[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    del key, ordered, wide
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh, dtype=np.int32) - 1]
    rank[n] = -1
    h = 8
    while h < depth:
        heads = np.flatnonzero(fresh)
        size = np.diff(np.concatenate((heads, [n])))
        many = size > 1
        if not many.any():
            break
        slots = np.flatnonzero(np.repeat(many, size))  # places in the order that are not settled
        member = order[slots]
        group = rank[member]
        both = group.astype(np.int64) << 32 | (rank[np.minimum(member + h, n)] + 1)
        by = np.argsort(both)
        member, both = member[by], both[by]
        order[slots] = member
        new = np.concatenate(([True], both[1:] != both[:-1]))
        fresh[slots] = new
        rank[member] = slots[np.flatnonzero(new)[np.cumsum(new, dtype=np.int32) - 1]]
        h *= 2
    return order, rank[:n]


def common_prefixes(buffer: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place in the order, the bytes that its suffix shares with the one before, up to ``most``.

    Kasai's way through the text: a suffix shares at least one byte less than the suffix at the place before did. That holds only
    where the two suffixes stand in the same order one place on, which an order by a limited depth doesn't promise, so it is
    looked up. All stretches of the text (from ``starts``, of ``lengths``) are gone through side by side.
    """
    n = len(buffer)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    eight = np.ndarray((n + 1,), np.dtype("<u8"), np.concatenate((buffer, np.zeros(8, np.uint8))), strides=(1,))  # eight bytes from each place on
    out = np.zeros(n, np.int32)
    parts = -(-lengths // STRETCH)  # each begins anew, so that a long one doesn't go on alone
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, lengths = np.repeat(starts, parts) + part * STRETCH, np.minimum(np.repeat(lengths, parts) - part * STRETCH, STRETCH)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    h = np.zeros(len(starts), np.int64)
    partner = np.full(len(starts), n)
    for i in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths, -i, side="left"))  # stretches that reach place i
        position = starts[:live] + i
        spot = place[position]
        before = np.where(spot > 0, order[spot - 1], n)
        follow = partner[:live] + 1
        kept = (follow < n) & (place[np.minimum(follow, n - 1)] < spot)
        own = np.where(kept, np.maximum(h[:live] - 1, 0), 0)
        limit = np.minimum(most, n - np.maximum(position, before))
        active = np.flatnonzero(own < limit)
        while len(active):
            x = eight[np.minimum(position[active] + own[active], n)] ^ eight[np.minimum(before[active] + own[active], n)]
            same = np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3)  # bytes until the first that differs
            own[active] += same
            active = active[(same == 8) & (own[active] < limit[active])]
        own = np.minimum(own, limit)
        out[spot] = own
        h[:live], partner[:live] = own, before
    return out


def shard_repeats(texts: list[bytes], counts: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with starts: which context each start is of, its place there, and the first start in the shard with the same string.

    Starts are numbered in the order of document and offset, so the first of equal ones is the earliest.
    """
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    order, _ = suffix_array(buffer)
    group = np.empty(len(buffer), np.int32)
    group[order] = np.cumsum(common_prefixes(buffer, order, begin, lengths) < LENGTH, dtype=np.int32)
    context = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(context)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = group[begin[context] + place]
    by = np.lexsort((offset[context] + place, doc[context], own))
    ordered = own[by]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(by) else np.zeros(0, bool)
    first = np.empty(len(by), np.int64)
    first[by] = by[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return context, place, first


def _sharded(rows: DataFrame) -> DataFrame:
    """Rows (shard, anchor, own, split, doc_id, spot, bytes) as starts that repeat; of split anchors also 128-bit hashes of the strings that stay, for the merge.

    Rows without bytes are of a context that another row of the shard leads: they repeat it.
    """
    names = ["doc_id", "spot", "string", "shard"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())

    def of_shard(found: pa.Table) -> pa.Table:
        shard = found.column("shard")[0].as_py()
        doc, spot, split, anchor, own = (found.column(c).to_numpy() for c in ("doc_id", "spot", "split", "anchor", "own"))
        held = found.column("bytes").is_valid().to_numpy()
        texts = utf8(found.column("bytes").filter(pa.array(held)))
        same = mixed(mixed(anchor.view(np.uint64)) + own.view(np.uint64))
        rest = ~held & np.isin(same, same[held])
        doc_of, offset, counts, parted = doc[held], spot[held] >> 24, spot[held] & MOST, split[held]
        context, place, first = shard_repeats(texts, counts, doc_of, offset)
        at = offset[context] + place
        leads = (doc_of[context] == doc_of[context[first]]) & (at == at[first])  # the earliest, or a repeated row of it
        d, o, c = _stretches(np.concatenate((doc_of[context[~leads]], doc[rest])), np.concatenate((at[~leads], spot[rest] >> 24)), np.concatenate((np.ones(int((~leads).sum()), np.int64), spot[rest] & MOST)))
        d, s = _packed(d, o, c)
        stay = np.flatnonzero((first == np.arange(len(first))) & parted[context])
        strings = [blake2b(texts[k][p : p + LENGTH], digest_size=16).digest() for k, p in zip(context[stay].tolist(), place[stay].tolist(), strict=True)]
        columns = (np.concatenate((d, doc_of[context[stay]])), np.concatenate((s, _spots(at[stay], np.ones(len(stay), np.int64)))), [None] * len(d) + strings, np.full(len(d) + len(stay), shard))
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    return rows.groupBy("shard").applyInArrow(of_shard, "doc_id long, spot long, string binary, shard long")


Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def merge_two(a: Run, b: Run) -> tuple[Run, np.ndarray, np.ndarray]:
    """Two sorted runs of strings (string, document, spot), no string twice in one, as one: each of ``b`` is looked up in ``a`` by binary search.

    Of a string of both the earlier place stays; the later ones are returned beside the merged run.
    """
    at = np.searchsorted(a[0], b[0])
    hit = np.zeros(len(b[0]), bool)
    inside = at < len(a[0])
    hit[inside] = a[0][at[inside]] == b[0][inside]
    mine, other = at[hit], np.flatnonzero(hit)
    swap = (b[1][other] < a[1][mine]) | ((b[1][other] == a[1][mine]) & (b[2][other] < a[2][mine]))
    same = (b[1][other] == a[1][mine]) & (b[2][other] == a[2][mine])  # of repeated rows of one document
    doc, spot = a[1].copy(), a[2].copy()
    doc[mine[swap]], spot[mine[swap]] = b[1][other[swap]], b[2][other[swap]]
    late_doc = np.where(swap, a[1][mine], b[1][other])[~same]
    late_spot = np.where(swap, a[2][mine], b[2][other])[~same]
    new = ~hit
    return (np.insert(a[0], at[new], b[0][new]), np.insert(doc, at[new], b[1][new]), np.insert(spot, at[new], b[2][new])), late_doc, late_spot


def merge_runs(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of several shards, merged two by two; the places whose string also stands earlier in another run."""
    docs, spots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(runs) > 1:
        merged = []
        for k in range(0, len(runs) - 1, 2):
            both, doc, spot = merge_two(runs[k], runs[k + 1])
            merged.append(both)
            docs.append(doc)
            spots.append(spot)
        runs = merged + runs[len(runs) // 2 * 2 :]
    return np.concatenate(docs), np.concatenate(spots)


def _merged(strings: DataFrame, buckets: int) -> DataFrame:
    """Of the strings that shards kept, the starts that another shard has earlier. Strings are dealt to buckets by hash: a bucket has each string once for each shard at most."""

    def of_bucket(found: pa.Table) -> pa.Table:
        doc, spot, shard = (found.column(c).to_numpy() for c in ("doc_id", "spot", "shard"))
        string = np.array(found.column("string").to_pylist(), "S16")
        order = np.lexsort((string, shard))
        edges = np.append(np.flatnonzero(_fresh(shard[order])), len(order))
        runs = [(string[own], doc[own], spot[own]) for own in (order[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))]
        late_doc, late_spot = merge_runs(runs)
        return pa.table([pa.array(late_doc), pa.array(late_spot)], names=["doc_id", "spot"])

    bucket = F.pmod(F.xxhash64("string"), F.lit(buckets))
    return strings.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(of_bucket, "doc_id long, spot long")


def repeats(docs: DataFrame, *, text: str = "text", split: int = SPLIT, shard: int = SHARD) -> DataFrame:
    """Stretches of starts (doc_id, spot) whose LENGTH bytes also start earlier, for all of ``docs``; see remove_repeats."""
    decided = materialise(_repeated(_anchored(docs, text), split))
    known = decided.where("anchor is null").select("doc_id", "spot")
    rows = decided.where("anchor is not null and lead")
    size = rows.agg(F.sum(F.col("spot").bitwiseAND(F.lit(MOST)) + LENGTH - 1)).first()[0]
    if not size:
        return known
    by_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "own", "spot", "part", "split")).alias("spots"))
    concerned, _ = parted(docs.select("doc_id", text), rows.select("doc_id"))
    context = "anchor long, own long, doc_id long, spot long, part long, split boolean, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(("anchor", "own", "doc_id", "spot", "part", "split", "bytes"), (*[pa.int64()] * 5, pa.bool_(), pa.binary()), strict=True))
        for batch in pieces(batches, text, 2 << 20):
            out: list[tuple] = []
            for doc, value, spots in zip(batch.column("doc_id").to_pylist(), utf8(batch.column(text)), batch.column("spots").to_pylist(), strict=True):
                for s in spots:
                    at = s["spot"] >> 24
                    out.append((s["anchor"], s["own"], doc, s["spot"], s["part"], s["split"], value[at : at + (s["spot"] & MOST) + LENGTH - 1]))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    contexts = concerned.join(by_doc, "doc_id").mapInArrow(cut, context)
    others = decided.where("anchor is not null and not lead").select("anchor", "own", "doc_id", "spot", "part", "split", F.lit(None).cast("binary").alias("bytes"))
    shards = max(1, -(-size // shard))
    dealt = contexts.union(others).select(F.pmod(F.xxhash64("anchor", "part"), F.lit(shards)).alias("shard"), "anchor", "own", "split", "doc_id", "spot", "bytes")
    out = materialise(_sharded(dealt))
    return known.union(out.where("string is null").select("doc_id", "spot")).union(_merged(out.where("string is not null"), shards))


def remove_repeats(docs: DataFrame, *, text: str = "text", split: int = SPLIT, shard: int = SHARD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, ``spans`` (start and end of removed bytes), ``kept`` (the other bytes).

    Texts are UTF-8 bytes, null is empty; each byte goes that is inside a string of LENGTH bytes that also starts earlier, in a
    document of a smaller id or before in the same one. Strings are judged in the input; rows of one id are one document, and rows
    without an id (a long) are left as they are. Shorter texts stay whole, repeated rows lose the same bytes, an empty table gives
    an empty one. Other columns are not used. Shards have ``shard`` bytes or so; an anchor of more than ``split`` rows is dealt to
    several. Which rows of an anchor have the same context is told by 64-bit hashes; each context's bytes go to an array once.
    """
    spots = materialise(repeats(docs, text=text, split=split, shard=shard))
    by_doc = spots.groupBy("doc_id").agg(F.collect_list("spot").alias("spots"))
    concerned, others = parted(docs.select("doc_id", text), spots.select("doc_id"))
    joined = concerned.join(by_doc, "doc_id", "left")
    if others is not None:
        joined = joined.unionByName(others.withColumn("spots", F.lit(None).cast("array<long>")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sizes, spans, kept = [], [], []
            for value, own in zip(utf8(batch.column(text)), batch.column("spots").to_pylist(), strict=True):
                sizes.append(len(value))
                found: list[tuple[int, int]] = []
                for s in sorted(own or ()):
                    a, b = s >> 24, (s >> 24) + (s & MOST) + LENGTH - 1
                    if found and a <= found[-1][1]:
                        found[-1] = (found[-1][0], max(b, found[-1][1]))
                    else:
                        found.append((a, b))
                rest, at = [], 0
                for a, b in found:
                    rest.append(value[at:a])
                    at = b
                kept.append(b"".join([*rest, value[at:]]))
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(done: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, bytes]]:
    """The same with a set of all strings; for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(s)
        out[doc] = (len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out
