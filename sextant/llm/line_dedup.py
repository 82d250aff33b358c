"""Line deduplication: hashes of bytes and of left-out words bring lines together, SimHash, edit similarity, and one occurrence for each connected group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import BROADCAST_ROWS, WORD_BYTES, components, hubs, materialise, mixed, parted, pieces, small_side, trimmed, utf8

#: Bits in which the SimHashes of two linked lines of LONG words or more may differ: unrelated lines differ in some 32.
BITS = 18
SIMILARITY = 0.9
#: Lines of fewer words, which any line of a script without spaces is, meet by their bytes: those of at least TINY bytes by what is left without
#: one, which is all that may differ below TWICE bytes, others by the least hash of runs of 8 bytes, or of GRAM bytes where they are MANY or longer.
#: These ranges overlap by a tenth, as lengths of alike lines may differ.
FEWEST = 4
TINY, TWICE, MANY = 10, 20, 48
#: Lines of up to SHORT words meet by what is left without one word, of PAIRED words also without two; lines of LONG words or more
#: by the least hash of their runs of GRAM bytes in each of BINS bins of hashes. The ranges overlap, as edits join and split words.
SHORT, PAIRED, LONG = 13, range(6, 11), 11
GRAM, BINS = 16, 5
#: Members of a bucket that are compared in one task; larger buckets are dealt in squares of two such parts.
PART = 4_000
_RANDOM = np.random.default_rng(33)
_GRAM = _RANDOM.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, SHORT, dtype=np.uint64) | np.uint64(1)
_BYTES = _RANDOM.integers(1, 1 << 63, TWICE + TWICE // 10, dtype=np.uint64) | np.uint64(1)
#: The lowest bit of each of eight bytes.
_LOW = np.uint64(0x0101010101010101)
#: The first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LINE_BYTES = bytes(10 if b == 10 else c for b, c in enumerate(WORD_BYTES))


class Lines:
    """The lines with words of some texts, as flat arrays: texts follow one another with a newline between."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts).translate(LINE_BYTES) + b"\n", np.uint8)
        word = raw > 32
        before = np.concatenate(([False], word[:-1]))
        edges = np.flatnonzero(word != before)  # where a word begins and where it ends, in turn, as the last byte is none's
        starts, ends = edges[::2], edges[1::2]
        upto = np.searchsorted(starts, np.flatnonzero(raw == 10))  # words before each line's end
        sizes = np.diff(upto, prepend=0)
        #: Words of each line, and its number among all lines; bytes of each line, with one space between words.
        self.number = np.flatnonzero(sizes)
        self.sizes = sizes[self.number]
        first = upto[self.number] - self.sizes
        lengths = ends - starts
        self.bytes = (np.add.reduceat(lengths, first) + self.sizes - 1) if len(first) else np.zeros(0, np.int64)
        #: All words with a byte after each, and where words begin.
        self.buffer = np.concatenate((raw[word | before], np.zeros(GRAM + 8, np.uint8)))
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.first = first
        self.words = word_numbers(self.buffer, self.starts, lengths)

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The text of each line, and its number there."""
        counts = np.array([x.count(b"\n") + 1 for x in texts])
        base = np.cumsum(counts) - counts
        owner = np.searchsorted(base, self.number, side="right") - 1
        return owner, self.number - base[owner]


def word_numbers(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word, eight bytes of all words at a time."""
    eight = np.ndarray((len(buffer) - 7,), np.dtype("<u8"), buffer, strides=(1,))
    out = mixed(lengths.astype(np.uint64) * _GRAM[0] * _GRAM[1] + (eight[starts] & _FIRST[np.minimum(lengths, 8)]))
    which = np.flatnonzero(lengths > 8)
    at, left = starts[which] + 8, lengths[which] - 8
    while len(which):
        out[which] = mixed(out[which] * _GRAM[1] + (eight[at] & _FIRST[np.minimum(left, 8)]))
        longer = left > 8
        which, at, left = which[longer], at[longer] + 8, left[longer] - 8
    return out


def signatures(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Of each line a key of its words in their order, and the SimHash of the words."""
    sizes, starts, flat = lines.sizes, lines.first, lines.words
    place = (np.arange(len(flat)) - np.repeat(starts, sizes)).astype(np.uint64)
    key = mixed(np.add.reduceat(mixed(flat + place * np.uint64(0x9E3779B97F4A7C15)), starts) + sizes.astype(np.uint64))
    parts = -(-sizes // 255)  # of up to 255 words, so that no byte runs over
    first = np.cumsum(parts) - parts
    at = (np.arange(parts.sum()) - np.repeat(first, parts)) * 255 + np.repeat(starts, parts)
    sim = np.zeros((len(sizes), 8), np.uint8)
    for k in range(8):  # of each of the eight bytes that bit
        ones = np.add.reduceat(flat >> np.uint64(k) & _LOW, at).view(np.uint8).reshape(-1, 8)
        if len(ones) == len(sizes):
            more = ones > (sizes // 2).astype(np.uint8)[:, None]
        else:
            more = np.add.reduceat(ones, first, axis=0, dtype=np.int64) > (sizes // 2)[:, None]
        sim |= more.view(np.uint8) << np.uint8(k)
    return key.view(np.int64), sim.view(np.int64).ravel()


def least_in_bins(buffer: np.ndarray, at: np.ndarray, line: np.ndarray, ends: np.ndarray, n: int, gram: int = GRAM, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Of n lines the least hash of their runs in each bin, and where there is one. A run is the ``gram`` bytes, 8 or 16, from a word's first (``at``, of ``line``) on, inside the line."""
    inside = at + gram <= ends[line]
    at, line = at[inside], line[inside]
    eight = np.ndarray((len(buffer) - 7,), np.dtype("<u8"), buffer, strides=(1,))
    runs = mixed(eight[at] * _GRAM[0] + eight[at + 8] * _GRAM[1] if gram > 8 else eight[at] * _GRAM[1])
    kind = (runs >> np.uint64(40)).astype(np.uint8) % np.uint8(bins)
    least, some = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    for k in range(bins):
        spots = np.flatnonzero(kind == k)
        if len(spots):
            of = line[spots]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least[of[first], k] = mixed(np.minimum.reduceat(runs[spots], first) + np.uint64(k))
            some[of[first], k] = True
    return least, some


def least_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """least_in_bins of normalised lines."""
    buffer = np.frombuffer(b" ".join(texts) + b" " + bytes(GRAM + 8), np.uint8)
    lengths = np.array([len(x) + 1 for x in texts])
    at = np.concatenate(([0], np.flatnonzero(buffer[: lengths.sum() - 1] == 32) + 1))
    return least_in_bins(buffer, at, np.searchsorted(np.cumsum(lengths), at, side="right"), np.cumsum(lengths) - 1, len(texts))


def without_one(held: np.ndarray) -> np.ndarray:
    """For each row of bytes, all of one length, a hash of the whole, and of what is left without each of them."""
    n = held.shape[1]
    held = held.astype(np.uint64) + np.uint64(1)
    left = np.concatenate([np.zeros((len(held), 1), np.uint64), np.cumsum(held * _BYTES[:n], axis=1)], axis=1)
    right = np.cumsum((held[:, 1:] * _BYTES[: n - 1])[:, ::-1], axis=1)[:, ::-1]  # of the bytes after each, a place further down
    rest = left[:, :-1] + np.concatenate([right, np.zeros((len(held), 1), np.uint64)], axis=1)
    return mixed(np.concatenate([left[:, -1:] + np.uint64(n), rest + np.uint64(n - 1)], axis=1))


def without_words(words: np.ndarray, most: int) -> np.ndarray:
    """For each row of words, all of one number, a hash of the whole, of what is left without each of them, and with ``most`` of 2 without each two."""
    n = words.shape[1]
    left_out = [np.array(list(combinations(range(n), k)), np.int64) for k in range(most + 1)]
    # sums of the words before each place, as they stand and one and two places further down
    sums = [np.zeros((n + 1, len(words)), np.uint64) for _ in range(most + 1)]
    for k, x in enumerate(sums):
        np.cumsum((words[:, k:] * _PLACES[: n - k]).T, axis=0, out=x[k + 1 :])
    found = []
    for k, out in enumerate(left_out):
        value = np.repeat(sums[k][n:], len(out), axis=0)
        for i in range(k):
            value += sums[i][out[:, i]] - sums[i + 1][out[:, i] + 1]
        found.append(mixed(value + np.uint64(n - k)))
    return np.ascontiguousarray(np.concatenate(found).T)


def few_words(lines: Lines, chosen: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The buckets of those chosen lines that have up to FEWEST words, by their bytes; with one word more than has to be, as an edit may split a word."""
    which, found = [], []
    size, start = lines.bytes[chosen], lines.starts[lines.first[chosen]]
    few = lines.sizes[chosen] <= FEWEST
    for n in np.unique(size[few & (size >= TINY) & (size <= 1.1 * TWICE)]).tolist():
        own = np.flatnonzero(few & (size == n))
        values = without_one(lines.buffer[start[own][:, None] + np.arange(n)])
        which.append(np.repeat(own, n + 1))
        found.append(values.ravel())
    for gram, bins, own in ((8, 3 * BINS, np.flatnonzero(few & (size >= TWICE) & (size <= 1.1 * MANY))), (GRAM, 2 * BINS, np.flatnonzero(few & (size >= MANY)))):
        if len(own):
            place = np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + np.repeat(start[own], size[own])
            line = np.repeat(np.arange(len(own)), size[own])
            begins = lines.buffer[place] & 0xC0 != 0x80  # a code point
            least, some = least_in_bins(lines.buffer, place[begins], line[begins], start[own] + size[own], len(own), gram, bins)
            line, kind = np.nonzero(some)
            which.append(own[line])
            found.append(least[some])
    return which, found


def blocks(lines: Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of chosen lines, as place among those and number of the bucket, in their order."""
    sizes, begin = lines.sizes[chosen], lines.first[chosen]
    which, found = few_words(lines, chosen)
    which, found = [np.zeros(0, np.int64), *which], [np.zeros(0, np.uint64), *found]
    own = np.flatnonzero((sizes >= FEWEST) & (sizes <= SHORT))
    for n in np.unique(sizes[own]).tolist():
        some = own[sizes[own] == n]
        values = without_words(lines.words[begin[some][:, None] + np.arange(n)], 2 if n in PAIRED else 1)
        which.append(np.repeat(some, values.shape[1]))
        found.append(values.ravel())
    own = np.flatnonzero(sizes >= LONG)
    if len(own):
        word = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own]) + np.repeat(begin[own], sizes[own])
        ends = lines.starts[begin[own]] + lines.bytes[chosen[own]]
        least, some = least_in_bins(lines.buffer, lines.starts[word], np.repeat(np.arange(len(own)), sizes[own]), ends, len(own))
        line, kind = np.nonzero(some)
        which.append(own[line])
        found.append(least[some])
    which, found = np.concatenate(which), np.concatenate(found).view(np.int64)
    order = np.argsort(which, kind="stable")
    return which[order], found[order]


def _packed(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """64-bit numbers as the bytes of rows that have so many of them each."""
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.append(0, np.cumsum(counts) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _packed, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.int64, (ends[-1] - ends[0]) // 8, ends[0]), np.diff(ends) // 8


def _listed(docs: DataFrame, text: str) -> DataFrame:
    """A row for each line with words: document, line number, key, SimHash, size (see COLUMNS), buckets (64-bit numbers in a row), whether the document has the key before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in pieces(batches, text, 2 << 20):
            texts = utf8(batch.column(text))
            lines = Lines(texts)
            if not len(lines.sizes):
                continue
            key, sim = signatures(lines)
            owner, number = lines.of_texts(texts)
            doc, number = batch.column("doc_id").to_numpy()[owner], number.astype(np.int32)
            order = np.lexsort((number, key, doc))
            again = np.zeros(len(doc), bool)
            again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (number[order[1:]] != number[order[:-1]])
            # the same line in these documents is in buckets once
            first = np.sort(np.unique(key, return_index=True)[1])
            which, found = blocks(lines, first)
            counts = np.zeros(len(doc), np.int64)
            counts[first] = np.bincount(which, minlength=len(first))
            buckets = _packed(found, counts)
            size = np.where(lines.sizes < LONG, -lines.bytes, lines.bytes)
            own = [pa.array(doc), pa.array(number), pa.array(key), pa.array(sim), pa.array(size, pa.int32()), buckets, pa.array(again)]
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "line", "key", "sim", "size", "blocks", "again"])

    return docs.select("doc_id", text).where("doc_id is not null").mapInArrow(run, "doc_id long, line int, key long, sim long, size int, blocks binary, again boolean")


def differing(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """What is left of both without the beginning and the end that they share."""
    start, end, n = 0, 0, min(len(a), len(b))
    for size in (64, 8, 1):
        while start + size <= n and a[start : start + size] == b[start : start + size]:
            start += size
    a, b = a[start:], b[start:]
    n -= start
    for size in (64, 8, 1):
        while end + size <= n and a[len(a) - end - size : len(a) - end] == b[len(b) - end - size : len(b) - end]:
            end += size
    return a[: len(a) - end], b[: len(b) - end]


def at_most(a: bytes, b: bytes, reach: int) -> int:
    """A number that the edit distance doesn't exceed: what differs, cut at pieces that both have at most ``reach`` bytes apart. Fast where edits are few."""
    a, b = differing(a, b)
    longer, n = max(len(a), len(b)), len(a)
    if longer <= 24 or not a or not b:
        return longer
    for at in (n // 2, n // 4, 3 * n // 4):
        piece = a[at : at + 12]
        k = b.find(piece, max(0, at - reach), at + reach + len(piece))
        if k >= 0 and len(piece) >= 8:
            return at_most(a[:at], b[:k], reach) + at_most(a[at:], b[k:], reach)
    return longer


def distance(a: bytes, b: bytes, most: int = 1 << 60) -> int:
    """Edit distance: insertions, deletions and substitutions; a column of the table is two numbers with a bit for each place.

    Where it is over ``most``, some number over ``most``.
    """
    a, b = differing(a, b)
    if not a or not b:
        return len(a) + len(b)
    more = np.bincount(np.frombuffer(a, np.uint8), minlength=256) - np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    least = int(max(more.clip(min=0).sum(), -more.clip(max=0).sum()))  # bytes that one has and the other has not
    if least > most:
        return least
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, far = full, 0, len(a)  # up, down: where a column's values rise and fall
    for k, x in enumerate(b, 1 - len(b)):
        same = where.get(x, 0)
        zero = ((same & up) + up ^ up | same | down) & full
        rise, fall = down | full & ~(zero | up), up & zero
        far += bool(rise & last) - bool(fall & last)
        if far + k > most:  # each byte to come takes off one at most
            return far + k
        rise = rise << 1 | 1
        up, down = (fall << 1 | full & ~(zero | rise)) & full, rise & zero & full
    return far


def alike(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether the edit similarity, one less the distance by the longer length, is ``least`` or more."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    a, b = differing(a, b)
    return max(len(a), len(b)) <= most or (within(a, b, most) if len(a) >= len(b) else within(b, a, most))


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is ``most`` or less; b is no longer than a, nor shorter by more. As in _within, a band of the table is followed, here in one number."""
    own, other = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    more = np.bincount(own, minlength=256) - np.bincount(other, minlength=256)
    if max(more.clip(min=0).sum(), -more.clip(max=0).sum()) > most:  # bytes that one has and the other has not
        return False
    far = len(a) - len(b)
    front, full = (most - far) // 2, (1 << most + 1) - 1
    where = {x: int.from_bytes(np.packbits(own == x, bitorder="little").tobytes(), "little") << front for x in np.unique(own).tolist()}
    up, down, at = full ^ (1 << front) - 1, 0, front + far
    for c, x in enumerate(b):
        same = where.get(x, 0) >> c & full
        zero = ((same & up) + up ^ up | same | down) & full
        far += 1 - (zero >> at & 1)
        if far > most:
            return False
        rise, moved = down | full & ~(zero | up), zero >> 1
        up, down = zero & up | full & ~(moved | rise), moved & rise
    return True


#: Bands of up to so many 64-bit numbers are worked on side by side for many pairs; wider ones (lines of over 5,000 bytes) and few ones pair by pair.
WORDS_WIDE = 8


def _within(a: list[bytes], b: list[bytes], most: np.ndarray, wide: int) -> np.ndarray:
    """Whether the edit distance of a[k] and b[k] is ``most[k]`` or less, for all pairs side by side; b[k] is no longer than a[k].

    Of the table of distances only a band of ``most[k] + 1`` diagonals is followed, one bit for a place, ``wide`` numbers of 64 bits for a
    column: who goes further from the first cell's diagonal and from the last one's needs more edits. The distance is read along the
    diagonal that ends in the last cell, and a pair is left as soon as it is over ``most``.
    """
    order = np.argsort([-len(x) for x in b], kind="stable")
    a, b, most = [a[k] for k in order.tolist()], [b[k] for k in order.tolist()], most[order]
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    n, front, bits = len(a), (most - (la - lb)) // 2, 64 * wide
    held = np.zeros((n, int(front.max()) + int(la.max()) + bits), np.uint8)
    held[np.repeat(np.arange(n), la), np.arange(la.sum()) - np.repeat(np.cumsum(la) - la - front, la)] = np.frombuffer(b"".join(a), np.uint8)
    other = np.zeros((int(lb.max(initial=0)), n), np.uint8)
    other[np.arange(lb.sum()) - np.repeat(np.cumsum(lb) - lb, lb), np.repeat(np.arange(n), lb)] = np.frombuffer(b"".join(b), np.uint8)
    far, which = la - lb, np.arange(n)
    word, shift = (front + far) // 64, ((front + far) % 64).astype(np.uint64)
    full, one, top = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), np.uint64(63)
    up = [np.where(front - 64 * w < 64, full << np.clip(front - 64 * w, 0, 63).astype(np.uint64), np.uint64(0)) for w in range(wide)]
    down = [np.zeros(n, np.uint64) for _ in range(wide)]
    out = np.zeros(n, bool)
    for c in range(len(other)):
        live = int(np.searchsorted(-lb, -c, side="left"))  # those with a byte at c
        keep = None
        if live < len(lb):
            out[which[live:]] = far[live:] <= most[live:]
            keep = slice(live)
        elif c % 16 == 15 and (dead := far > most).sum() * 4 > len(far):
            keep = ~dead
        if keep is not None:
            held, other, far, most, lb, which, word, shift = held[keep], other[:, keep], far[keep], most[keep], lb[keep], which[keep], word[keep], shift[keep]
            up, down = [x[keep] for x in up], [x[keep] for x in down]
            if not len(far):
                return out[np.argsort(order)]
        same = np.packbits((held[:, c : c + bits] == other[c][:, None]).ravel(), bitorder="little").view(np.uint64).reshape(-1, wide)
        zeros, rises, falls, carry = [], [], [], None
        for w in range(wide):
            x, v = same[:, w], up[w]
            s = (x & v) + v
            if wide > 1:
                over = s < v
                if carry is not None:
                    s = s + carry
                    over |= s < carry
                carry = over.astype(np.uint64)
            zero = s ^ v | x | down[w]
            zeros.append(zero)
            rises.append(down[w] | ~(zero | v))
            falls.append(zero & v)
        hit = zeros[0] if wide == 1 else np.choose(word, zeros)
        far = far + 1 - (hit >> shift & one).astype(np.int64)
        for w in range(wide):
            moved = zeros[w] >> one
            if w + 1 < wide:
                moved |= zeros[w + 1] << top
            up[w] = falls[w] | ~(moved | rises[w]) & full
            down[w] = moved & rises[w]
    out[which] = far <= most
    return out[np.argsort(order)]


#: Pairs whose pair_counts are further apart than so much for each edit they may have are seldom told by at_most.
HOPEFUL = 1.25


def alike_pairs(texts: list[bytes], i: np.ndarray, j: np.ndarray, least: float = SIMILARITY, counts: np.ndarray | None = None) -> np.ndarray:
    """alike for the pairs texts[i[k]], texts[j[k]]; ``counts`` are the pair_counts of all texts, where they are known."""
    size = np.array([len(x) for x in texts])
    swap = size[i] < size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    most = ((1 - least) * size[i] + 1e-9).astype(np.int64)
    out = np.zeros(len(i), bool)
    left = np.flatnonzero(size[i] - size[j] <= most)
    if counts is None:
        used, place = np.unique(np.concatenate((i[left], j[left])), return_inverse=True)
        apart = _apart(pair_counts([texts[k] for k in used.tolist()]), place[: len(left)], place[len(left) :])
    else:
        apart = _apart(counts, i[left], j[left])
    left, apart = left[apart <= 4 * most[left]], apart[apart <= 4 * most[left]]
    hopeful = np.zeros(len(i), bool)
    hopeful[left] = apart <= HOPEFUL * most[left]
    wide = most[left] // 64 + 1
    for w in np.unique(wide).tolist():
        own = left[wide == w]
        if w > WORDS_WIDE:
            out[own] = [at_most(texts[x], texts[y], m) <= m or alike(texts[x], texts[y], least) for x, y, m in zip(i[own].tolist(), j[own].tolist(), most[own].tolist(), strict=True)]
            continue
        own = own[np.argsort(size[j[own]], kind="stable")]
        for at in range(0, len(own), 4096 // w):
            part = own[at : at + 4096 // w]
            likely = part[hopeful[part]]
            out[likely] = [at_most(texts[x], texts[y], most_) <= most_ for x, y, most_ in zip(i[likely].tolist(), j[likely].tolist(), most[likely].tolist(), strict=True)]
            rest = part[~out[part]]
            if len(rest):
                out[rest] = _within([texts[k] for k in i[rest].tolist()], [texts[k] for k in j[rest].tolist()], most[rest], w) if len(rest) >= 24 * w else [alike(texts[x], texts[y], least) for x, y in zip(i[rest].tolist(), j[rest].tolist(), strict=True)]
    return out


#: Counters of a line's pairs of bytes.
COUNTERS = 256

#: ``size`` is the number of bytes, negative for lines of fewer words than LONG.
COLUMNS = ("block", "key", "sim", "size")


def _near(sim: np.ndarray, signed: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs can be alike: their lengths differ little, and their SimHashes if both are long."""
    size = np.abs(signed)
    longer = np.maximum(size[i], size[j])
    differ = np.bitwise_count(sim[i].view(np.uint64) ^ sim[j].view(np.uint64))
    return (longer - np.minimum(size[i], size[j]) <= (1 - least) * longer + 1e-9) & ((differ <= BITS) | (np.minimum(signed[i], signed[j]) < 0))


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    fresh = np.zeros(max(0, n - 1), bool)
    for c in columns:
        fresh |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(fresh) + 1, [n])) if n else np.zeros(1, np.int64)


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """How many of each text's pairs of neighbouring bytes there are, by hash in COUNTERS counters, which are as many as a byte has values."""
    every = np.frombuffer(b"".join(texts), np.uint8)
    slots = every[:-1] * np.uint8(31) + every[1:] * np.uint8(7)
    out, end = np.zeros((len(texts), COUNTERS), np.int16), 0
    for k, text in enumerate(texts):
        start, end = end, end + len(text)
        if len(text) > 1:
            own = np.bincount(slots[start : end - 1], minlength=COUNTERS)
            out[k] = own if len(text) < 30_000 else own.clip(max=30_000)
    return out


def _apart(counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far the pair_counts of the pairs are apart: an edit is in two pairs of bytes before and after, so that it moves this by 4 at most."""
    parts = [np.abs(counts[i[at : at + 4096]] - counts[j[at : at + 4096]]).sum(1, dtype=np.int32) for at in range(0, len(i), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def spanning(group: np.ndarray, key: np.ndarray, sim: np.ndarray, signed: np.ndarray, texts: list[bytes], least: float, part: np.ndarray | None = None, known: np.ndarray | None = None, bins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all alike pairs within groups connect: as many as there are rows at most.

    Rows are in the order of their groups; with ``part``, pairs are of different parts; rows of one number in ``known`` are connected already. With ``bins``, the rows' buckets, pairs
    of long lines that an earlier bin's bucket has as well are left to that. In each group the first row meets all others, then
    the next two do, then the next four: pairs that links found before already connect needn't be compared.
    """
    _, first_row, node = np.unique(key, return_index=True, return_inverse=True)
    root = np.arange(len(first_row))
    if known is not None:
        _, one, of = np.unique(known[first_row], return_index=True, return_inverse=True)
        root = one[of]
    parent = root.tolist()

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = _edges(group)
    begin = np.repeat(edges[:-1], np.diff(edges))
    rank = np.arange(len(group)) - begin
    if bins is not None:
        own = np.flatnonzero(signed[first_row] > 0)  # long lines
        mins, some = np.zeros((len(first_row), BINS), np.uint64), np.zeros((len(first_row), BINS), bool)
        if len(own):
            chosen = [texts[k] for k in first_row[own].tolist()]
            mins[own], some[own] = least_runs(chosen)
        at_bin = np.where(some[node] & (mins[node] == bins.view(np.uint64)[:, None]), np.arange(BINS), BINS).min(1) % BINS  # 0: by left-out words, or first
    own_texts = [texts[k] for k in first_row.tolist()]
    counts = pair_counts(own_texts)
    most = (1 - least) * np.abs(signed[first_row]) + 1e-9
    found: list[tuple[int, int]] = []
    waiting: list[np.ndarray] = []
    rows, p, upto = np.arange(len(group)), 0, 1
    while True:
        rows = rows[rank[rows] > p]
        if len(rows):
            pivot = begin[rows] + p
            x, y = node[pivot], node[rows]
            ok = (root[x] != root[y]) & _near(sim, signed, pivot, rows, least)
            if part is not None:
                ok &= part[pivot] != part[rows]
            if bins is not None and ok.any():  # those that meet in an earlier bin, too, are compared there
                late = np.flatnonzero(ok & (at_bin[rows] > 0))
                x2, y2 = x[late], y[late]
                ok[late[((mins[x2] == mins[y2]) & some[x2] & some[y2] & (np.arange(BINS) < at_bin[rows[late]][:, None])).any(1)]] = False
            x, y = x[ok], y[ok]
            few = _apart(counts, x, y) <= 4 * np.maximum(most[x], most[y])
            waiting.append(np.minimum(x[few], y[few]) << 32 | np.maximum(x[few], y[few]))
        p += 1
        if waiting and (not len(rows) or p >= upto or sum(map(len, waiting)) > 100_000):
            both = np.unique(np.concatenate(waiting))
            waiting.clear()
            x, y = both >> 32, both & 0xFFFFFFFF
            linked = alike_pairs(own_texts, x, y, least, counts)
            for a, b in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                ra, rb = top(a), top(b)
                if ra != rb:
                    parent[ra] = rb
                    found.append((a, b))
            root = np.array([top(k) for k in range(len(parent))]) if linked.any() else root
        if not len(rows):
            break
        if p >= upto:
            upto = 2 * upto + 1
    ends = key[first_row[np.array(found, np.int64).reshape(-1, 2)]]
    return ends.min(1), ends.max(1)


#: Numbers of buckets that a task sends at once, and that it holds at most of a slot beside one for each bucket; lines for which there is a slot.
SENT, KEPT, SLOT_LINES = 1 << 19, 1 << 21, 1 << 11


def several(block: np.ndarray, key: np.ndarray, sent: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows (block, key) of buckets that have several keys, but those ``sent`` already, each once; and a row for each bucket, with whether it is sent."""
    order = np.argsort(block)
    same = block[order[1:]] == block[order[:-1]]
    many = np.append(False, same) | np.append(same, False)
    alone, order = order[~many], order[many]
    order = order[np.lexsort((~sent[order], key[order], block[order]))]
    b, k, s = block[order], key[order], sent[order]
    fresh = np.append(True, (b[1:] != b[:-1]) | (k[1:] != k[:-1]))[: len(b)]
    b, k, s = b[fresh], k[fresh], s[fresh]
    first = _edges(b)[:-1]
    sizes = np.diff(np.append(first, len(b)))
    shared = sizes > 1
    out = np.repeat(shared, sizes) & ~s
    gone = shared | (np.logical_or.reduceat(s, first) if len(first) else shared)
    # of a bucket that was sent the row that stays is one that was sent, too
    return (b[out], k[out]), (np.append(block[alone], b[first]), np.append(key[alone], k[first]), np.append(sent[alone], gone))


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (key, block), or (key, blocks) with the bytes of all buckets of a line, the rows (block, key) whose bucket has several keys.

    Buckets go to slots by their first bits, those of many lines in one row. In a slot of more than KEPT rows one may come twice.
    """
    bits, column = (rows.count() // SLOT_LINES).bit_length(), "blocks" if "blocks" in rows.columns else "block"

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            block, key = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            slot = (block.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(block), np.uint16)
            order = np.argsort(slot, kind="stable")
            edges = _edges(slot[order])
            return pa.RecordBatch.from_arrays([pa.array(slot[order][edges[:-1]].astype(np.int64)), *(_packed(x[order], np.diff(edges)) for x in (block, key))], names=["slot", "blocks", "keys"])

        for batch in batches:
            own = batch.column(column)
            block, counts = _unpacked(own) if column == "blocks" else (own.to_numpy(), 1)
            if len(block):
                held.append((block, np.repeat(batch.column("key").to_numpy(), counts)))
                if sum(len(x) for x, _ in held) >= SENT:
                    yield out()
        if held:
            yield out()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        slot, held, n = None, [], 0

        def done(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["block", "key"])

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            (block, counts), (key, _) = (_unpacked(batch.column(c)) for c in ("blocks", "keys"))
            ends, edges = np.append(0, np.cumsum(counts)), _edges(slots)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and slots[low] != slot:
                    yield done(several(*(np.concatenate(x) for x in zip(*held, strict=True)))[0])
                    held, n = [], 0
                own = slice(ends[low], ends[high])
                slot = slots[low]
                held.append((block[own].copy(), key[own].copy(), np.zeros(own.stop - own.start, bool)))
                n += own.stop - own.start
                if n >= KEPT:
                    found, left = several(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    yield done(found)
                    held, n = [left], 0
        if held:
            yield done(several(*(np.concatenate(x) for x in zip(*held, strict=True)))[0])

    dealt = rows.select("key", column).mapInArrow(sent, "slot long, blocks binary, keys binary")
    return dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(met, "block long, key long")


def _candidates(dealt: DataFrame, least: float) -> DataFrame:
    """Of rows (COLUMNS) those that can be alike to another of their bucket: (COLUMNS, part, centre).

    ``centre`` is the key that can be alike to most others; ``part`` is null but in a bucket of more than PART rows, all of which
    are there, in parts with a centre each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        held, dealt_before = None, 0  # the rows of the last bucket, and how many of them are dealt out already

        def done(rows: list[np.ndarray], before: int, more: bool = False) -> pa.RecordBatch:
            edges = _edges(rows[0])
            sizes = np.diff(edges)
            large = sizes > PART
            large[0] |= more or before > 0
            place = np.arange(len(rows[0])) - np.repeat(edges[:-1], sizes)
            place[: edges[1]] += before
            inside = np.repeat(large, sizes)
            partners = np.zeros(len(inside), np.int32)
            i, steps = np.flatnonzero(~inside), 1
            while True:
                i = i[: np.searchsorted(i, len(inside) - steps)]
                i = i[rows[0][i] == rows[0][i + steps]]
                if not len(i):
                    break
                near = _near(rows[2], rows[3], i, i + steps, least)
                partners[i[near]] += 1
                partners[i[near] + steps] += 1
                steps += 1
            part = place // PART
            group = np.cumsum(np.concatenate(([0], (rows[0][1:] != rows[0][:-1]) | (inside[1:] & (part[1:] != part[:-1])))))
            best = np.lexsort((rows[1], -partners, group))
            centre = best[np.flatnonzero(np.concatenate(([True], group[best][1:] != group[best][:-1])))][group]
            keep = inside | (partners > 0)
            columns = [*(pa.array(c[keep]) for c in rows), pa.array(part[keep].astype(np.int32), mask=~inside[keep]), pa.array(rows[1][centre[keep]])]
            return pa.RecordBatch.from_arrays(columns, names=[*COLUMNS, "part", "centre"])

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in COLUMNS]
            if not len(rows[0]):
                continue
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            again = np.concatenate(([False], (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])))
            rows = [c[~again] for c in rows]
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            if start:
                yield done([c[:start] for c in rows], dealt_before)
                dealt_before = 0
            held = [c[start:] for c in rows]
            while len(held[0]) > PART + 1:  # a row more stays, so that a repetition of it is seen
                yield done([c[:PART] for c in held], dealt_before, more=True)
                dealt_before += PART
                held = [c[PART:] for c in held]
        if held is not None and len(held[0]):
            yield done(held, dealt_before)

    return dealt.repartition("block").sortWithinPartitions("block", "key").select(*COLUMNS).mapInArrow(run, "block long, key long, sim long, size int, part int, centre long")


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """The normalised lines that ``wanted`` (doc_id, line, key) names, as a written table."""
    n = wanted.count()
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "key")).alias("wanted"))
    by_doc = F.broadcast(by_doc) if n <= BROADCAST_ROWS else by_doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in pieces(batches, text):
            keys, found = [], []
            for value, own in zip(utf8(batch.column(text)), batch.column("wanted").to_pylist(), strict=True):
                lines = value.split(b"\n")
                for w in own:
                    if w["line"] < len(lines):
                        keys.append(w["key"])
                        found.append(b" ".join(lines[w["line"]].translate(WORD_BYTES).split()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["key", "words"])

    found = materialise(docs.select("doc_id", text).join(by_doc, "doc_id").mapInArrow(run, "key long, words binary"))
    # each line is found, and again only in another row of its document's id
    return found if found.count() == n else materialise(found.dropDuplicates(["key"]))


#: Rows and bytes of lines that a task holds at once; one bucket, or square of a larger one, is held whole.
HELD_ROWS, HELD_BYTES = 50_000, 32 << 20


def _starred(found: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The links (a, b) of rows with the centres of their buckets, whose pairs are mostly the same in all buckets of a group of lines."""
    pairs = found.where("key != centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("words").alias("of_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("words").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            n = batch.num_rows
            linked = alike_pairs(batch.column("of_a").to_pylist() + batch.column("of_b").to_pylist(), np.arange(n), np.arange(n, 2 * n), least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _linked(found: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of keys (a, b) that connect what alike pairs of a common bucket connect, beyond rows of one ``root``. Buckets of more than PART rows are dealt in squares of two parts."""
    large = found.where("part is not null")
    parts = large.groupBy("block").agg(F.max("part").alias("parts"))
    squares = large.join(parts, "block").withColumn("other", F.explode(F.sequence(F.lit(0), "parts")))
    squares = squares.select(*COLUMNS, "root", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    whole = found.where("part is null").select(*COLUMNS, "root", F.lit(0).alias("part"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    names = (*COLUMNS, "root", "part", "low", "high", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            block, key, sim, size, root, part, low, high = (table.column(c).to_numpy() for c in names[:-1])
            edges = _edges(block, low, high)
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            words = table.column("words").to_pylist()
            for crossed in (False, True):
                own = np.flatnonzero((low != high) == crossed)
                if len(own):
                    a, b = spanning(group[own], key[own], sim[own], size[own], [words[k] for k in own.tolist()], least, part[own] if crossed else None, root[own], block[own])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= HELD_ROWS or sum(x.nbytes for x in held) >= HELD_BYTES:
                table = pa.Table.from_batches(held)
                edges = _edges(*(table.column(c).to_numpy() for c in ("block", "low", "high")))
                if len(edges) > 2:
                    yield from done(table.slice(0, edges[-2]))
                held = table.slice(edges[-2]).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    dealt = whole.union(squares).join(texts, "key").select(*names)
    return dealt.repartition("block", "low", "high").sortWithinPartitions("block", "low", "high", "part", "key").mapInArrow(run, "a long, b long")


def _links(listed: DataFrame, distinct: DataFrame, docs: DataFrame, text: str, least: float) -> DataFrame:
    """Pairs of keys (a, b) of alike lines, which connect all alike lines that have a bucket in common."""
    found = materialise(_candidates(_shared(listed).join(distinct.select("key", "sim", "size"), "key"), least))
    wanted = materialise(distinct.select("doc_id", "line", "key").join(small_side(materialise(found.select("key").distinct())), "key", "left_semi"))
    texts = _texts(docs, wanted, text)
    links = materialise(_starred(found, texts, least))
    # the centre of a bucket of up to PART rows has been compared with all of them
    rooted = found.where("part is not null or key != centre").join(hubs(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = materialise(rooted.select(*COLUMNS, "part", "root"))
    open_ = rooted.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("block")
    return links.union(_linked(materialise(rooted.join(open_, "block", "left_semi")), texts, least))


def repeated_lines(docs: DataFrame, *, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The lines (doc_id, line) that are not their group's first occurrence; see deduplicate."""
    listed = materialise(_listed(docs, text))
    distinct = materialise(listed.where("not again").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("line", "doc_id").alias("line"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("sim", "size"))))
    roots = small_side(materialise(components(_links(listed, distinct, docs, text, least))))
    repeated = distinct.join(roots, distinct.key == roots.node, "left").where("root is not null or copies > 1")
    repeated = materialise(repeated.select("key", "root", "doc_id", "line"))
    grouped = repeated.where("root is not null")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("kept"))
    plain = repeated.where("root is null").select("key", F.struct("doc_id", "line").alias("kept"))
    kept = small_side(materialise(plain.union(grouped.join(first, "root").select("key", "kept"))))
    return listed.join(kept, "key", "left").where("again or doc_id != kept.doc_id or line != kept.line").select("doc_id", "line")


def deduplicate(docs: DataFrame, *, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with the lines of ``text`` that are left, and ``n_lines``, the lines before, and ``n_removed``, the lines that went.

    Lines are normalised to their words (lower case for A-Z, punctuation as white space). Lines of the same words are copies; others
    are linked if their edit similarity, of bytes, is ``least`` or more, which takes TINY bytes at least. Candidates are all pairs that share a
    bucket (see FEWEST and SHORT), whatever its size, apart from long lines whose SimHashes differ in more than BITS of 64 bits. Of a connected group the
    occurrence with the smallest document id, and there the smallest line number, stays. Lines without words stay. Null stays
    null, with no lines; rows without an id stay whole, rows of one id (a long) count as one document, so that repeated rows lose
    the same lines. An empty table gives an empty table. Columns by the names of the result are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    mark = "_gone" + "_" * max(map(len, docs.columns))  # no column of docs
    gone = materialise(repeated_lines(docs, text=text, least=least).groupBy("doc_id").agg(F.collect_set("line").alias(mark)))
    concerned, others = parted(docs, gone.select("doc_id"))
    joined, kept = concerned.join(gone.hint("shuffle_hash"), "doc_id", "left"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in pieces(batches, text):
            values, left = batch.column(text), []
            mask = pc.and_(batch.column(mark).is_valid(), values.is_valid())
            n_lines = pc.fill_null(pc.add(pc.count_substring(values, "\n").cast(pa.int64()), 1), 0)
            n_removed = np.zeros(batch.num_rows, np.int64)
            touched = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            for at, value, own in zip(touched.tolist(), values.filter(mask).to_pylist(), batch.column(mark).filter(mask).to_pylist(), strict=True):
                drop = set(own)
                n_removed[at] = len(drop)
                left.append("\n".join(x for k, x in enumerate(value.split("\n")) if k not in drop))
            values = pc.replace_with_mask(values, mask, pa.array(left, values.type)) if left else values
            columns = [values if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(n_removed)], names=[*kept, "n_lines", "n_removed"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    done = joined.select(*kept, mark).mapInArrow(run, f"{fields}n_lines long, n_removed long")
    if others is None:
        return done
    n_lines = F.octet_length(others[text]) - F.octet_length(F.replace(others[text], F.lit("\n"), F.lit(""))) + 1
    return done.union(others.select(*kept, F.coalesce(n_lines.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")))


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
