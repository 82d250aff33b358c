"""Line dedup: what is compared once isn't compared again, and its short cuts against the plain ways."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sextant.llm import line_dedup

from .test_operators import docs_of


def test_pairs_with_the_centre_are_compared_once(spark, monkeypatch):
    """A bucket of two unlike lines is settled with its centre; of three, one pair is left."""
    compared = []
    linked = line_dedup._linked
    monkeypatch.setattr(line_dedup, "_linked", lambda found, *more: compared.append(found.count()) or linked(found, *more))
    start = "alpha bravo charlie delta"
    texts = [f"{start} echo foxtrot", f"{start} golf novembe", f"{start} kilo quebecs"]
    for n, rows in ((2, 0), (3, 2)):
        assert line_dedup.repeated_lines(docs_of(spark, texts[:n], extra=False)).count() == 0 and compared.pop() == rows


def test_shared_buckets(spark, monkeypatch):
    """Rows of buckets with several keys, from single rows and from packed ones, in whole slots and in cut ones, with negative numbers."""
    r = random.Random(4)
    pairs = [(r.randrange(-40, 40) << 57, r.randrange(4)) for _ in range(150)] + [(1 << 40, k % 90) for k in range(300)] + [(5, 7)] * 80
    keys = {b: {k for x, k in pairs if x == b} for b, _ in pairs}
    want = {(b, k) for b, own in keys.items() if len(own) > 1 for k in own}
    single = spark.createDataFrame(pairs, "block long, key long")
    by_key = {k: np.array([b for b, x in pairs if x == k], "<i8").tobytes() for k in {k for _, k in pairs}}
    packed = spark.createDataFrame([(k, bytearray(v)) for k, v in by_key.items()] + [(1000, bytearray())], "key long, blocks binary")
    for kept, sent, lines in ((1 << 21, 1 << 19, 1 << 11), (40, 30, 1 << 11), (40, 30, 8)):
        for name, value in (("KEPT", kept), ("SENT", sent), ("SLOT_LINES", lines)):
            monkeypatch.setattr(line_dedup, name, value)
        for rows in (single, packed):
            got = [tuple(x) for x in line_dedup._shared(rows).collect()]
            assert set(got) == want and (kept == 40 or len(got) == len(want))
    assert line_dedup._shared(single.where(F.lit(False))).count() == 0


def test_buckets_by_left_out_words():
    r = np.random.default_rng(1)
    for n in range(4, 14):
        words, most = r.integers(0, 1 << 63, (20, n), dtype=np.uint64), 2 if n in line_dedup.PAIRED else 1
        got = line_dedup.without_words(words, most)
        for row, values in zip(words.tolist(), got.tolist(), strict=True):
            left = [[row[k] for k in own] for out in range(most + 1) for own in combinations(range(n), n - out)]
            want = [sum(x * int(p) for x, p in zip(own, line_dedup._PLACES)) + len(own) & 0xFFFFFFFFFFFFFFFF for own in left]
            assert sorted(values) == sorted(line_dedup.mixed(np.array(want, np.uint64)).tolist())


def test_band_of_one_pair():
    r = random.Random(2)
    for _ in range(400):
        a = bytes(r.choice(b"abc ") for _ in range(r.randint(1, 150)))
        b = bytearray(a)
        for _ in range(r.randint(0, 14)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choice([b"x", b"", b"a"])
        long, short = sorted((a, bytes(b)), key=len, reverse=True)
        d = line_dedup.distance(a, bytes(b))
        for most in {max(d - 1, 0), d, d + 1, d + 9}:
            assert len(long) - len(short) > most or line_dedup.within(long, short, most) == (d <= most)


def test_band_of_as_many_diagonals_as_edits():
    """One number of 64 bits does for up to 63 edits, whatever the lengths differ by; before, it did for 31."""
    r = random.Random(6)
    for wide in (1, 2, 3):
        a, b, most, want = [], [], [], []
        for _ in range(120):
            text = bytes(r.choice(b"abcde ") for _ in range(r.randint(100, 300)))
            other = bytearray(text)
            for _ in range(r.randint(0, 12 * wide)):
                at = r.randint(0, len(other))
                other[at : at + r.choice([0, 1, 9])] = bytes(r.choice(b"abx") for _ in range(r.choice([0, 1, 9])))
            long, short = sorted((text, bytes(other)), key=len, reverse=True)
            d = line_dedup.distance(long, short)
            for k in {d - 1, d, d + 3, 64 * wide - 1}:
                if len(long) - len(short) <= k < 64 * wide:
                    a, b, most, want = [*a, long], [*b, short], [*most, k], [*want, d <= k]
        assert line_dedup._within(a, b, np.array(most), wide).tolist() == want and len(set(want)) == 2
        assert [line_dedup.within(x, y, k) for x, y, k in zip(a, b, most, strict=True)] == want


def test_pairs_of_other_bytes_are_not_aligned(monkeypatch):
    """Pairs of bytes tell some unlike lines apart."""

    def refused(*_):
        raise AssertionError

    lines = [b"abcdefghij klmnopqrst " * 9, b"tsrqponmlk jihgfedcba " * 9, b"abcdefghij klmnopqrst " * 8 + b"abcdefghij klmnopqrsx "]
    counts = line_dedup.pair_counts([*lines, b"", b"a"])
    for line, own in zip([*lines, b"", b"a"], counts, strict=True):
        want = np.zeros(line_dedup.COUNTERS, int)
        for x, y in zip(line, line[1:]):
            want[(31 * x + 7 * y) % line_dedup.COUNTERS] += 1
        assert own.tolist() == want.tolist()
    for name in ("within", "_within"):
        monkeypatch.setattr(line_dedup, name, refused)
    for known in (None, counts):
        assert line_dedup.alike_pairs(lines, np.array([0, 0]), np.array([1, 2]), counts=known).tolist() == [False, True]
    monkeypatch.setattr(line_dedup, "at_most", refused)
    assert line_dedup.alike_pairs(lines, np.array([0, 1]), np.array([1, 2])).tolist() == [False, False]


def test_lines_again_and_alike_go_once(spark):
    """A line again in its document, again elsewhere, and alike to another that is there again: all from one reading of the lines, each once."""
    start = "alpha bravo charlie delta echo foxtrot golf"
    texts = [f"{start}\nsome other words of a line here", f"{start}\n{start}", f"{start}s\n{start}s\n{start}", "nothing like the rest of these lines"]
    gone = sorted(tuple(x) for x in line_dedup.repeated_lines(docs_of(spark, texts, extra=False)).collect())
    assert [x[1] for x in gone] == [0, 1, 0, 1, 2] and len({x[0] for x in gone}) == 2


def test_lines_of_repeated_rows_are_read_once(spark):
    """Lines of rows that a document has twice come once."""
    docs = spark.createDataFrame([(1, "one line of words\nand another"), (1, "one line of words\nand another"), (2, "a third line")], "doc_id long, text string")
    wanted = spark.createDataFrame([(1, 0, 11), (1, 1, 12), (2, 0, 13)], "doc_id long, line int, key long")
    for some in (docs, docs.distinct()):
        got = sorted(tuple(x) for x in line_dedup._texts(some, wanted, "text").collect())
        assert [(k, bytes(w)) for k, w in got] == [(11, b"one line of words"), (12, b"and another"), (13, b"a third line")]


def test_simhash_is_the_majority_of_bits():
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(n)}" for _ in range(n)).encode() for n in (1, 2, 7, 40, 255, 256, 511, 900)]
    for some in (texts[:5], texts):
        lines = line_dedup.Lines([b"\n".join(some)])
        for own, first, size in zip(line_dedup.signatures(lines)[1].tolist(), lines.first, lines.sizes, strict=True):
            words = lines.words[first : first + size].tolist()
            assert own & 0xFFFFFFFFFFFFFFFF == sum(1 << k for k in range(64) if 2 * sum(w >> k & 1 for w in words) > len(words))


def test_documents_without_repeated_lines_stay_as_they_are(spark):
    """Lines are counted alike in documents that lose some and in those that lose none, and null stays null, in a repeated row, too."""
    same = "the very same words are here"
    rows = [(1, f"{same}\n\nof one"), (2, f"of two\n{same}\n"), (3, "\n\nÄ\n"), (4, ""), (5, None), (None, f"{same}\n{same}"), (6, same), (6, None)]
    done = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(x.doc_id, x.text, x.n_lines, x.n_removed) for x in done.collect()}
    assert got == {(1, rows[0][1], 3, 0), (2, "of two\n", 3, 1), (3, "\n\nÄ\n", 4, 0), (4, "", 1, 0), (5, None, 0, 0), (None, f"{same}\n{same}", 2, 0), (6, "", 1, 1), (6, None, 0, 0)}
