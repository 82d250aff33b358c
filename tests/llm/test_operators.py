"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import decontaminate, html_text, line_dedup, media, near_dedup, packing, pii, substrings, toxicity, urls
from sextant.llm.common import components

WORDS = "an be cor da el fin go hal is jo ka lem mi nor os pa qui ra sol ta un ver wa yes zon été über".split()


def prose(r, n):
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 3))) for _ in range(n))


def docs_of(spark, texts, extra=True):
    """Documents with ids from 0, with columns that clash with the operators' own."""
    rows = [(k, t, "en", "x", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score string, n int" if extra else "doc_id long, text string, lang string, source string, n_chars long")


def table(df, key=0):
    return {r[key]: tuple(r) for r in df.collect()}


# 1


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_base_patterns_equal_the_plain_expressions():
    r = random.Random(1)
    pieces = ["a@b.c", "x.y@", "@z.com", "1.2.3.4", "10.0.0.256.1", "4316522678525456", "4465 7583-8288 9437", "+1 (743) 555-3824", "+", " ", ".", "-", "7", "é", "user@host", "0001.002.3.4", "a@b.c@d.e", "\n"]
    for _ in range(4000):
        text = "".join(r.choices(pieces, k=r.randint(0, 9)))
        assert pii.base_spans(text) == slow_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000):
        pii.base_spans(text)


def test_crf_finds_held_out_entities_and_its_sums_are_right():
    model = pii.trained()
    found = missed = wrong = 0
    for tokens, gold in pii.make_examples(200, 1234):
        got = set(model.decode(tokens))
        found, missed, wrong = found + len(got & set(gold)), missed + len(set(gold) - got), wrong + len(got - set(gold))
    assert found / (found + missed) > 0.95 and found / (found + wrong) > 0.95
    # expected counts against a list of all segmentations
    spans, r = [(0, 2), (1, 3), (2, 4), (0, 4)], np.random.default_rng(0)
    scores = r.normal(size=(4, 5))
    scores[:, 0] = 0
    crf = pii.SemiMarkovCRF()
    crf.moves = r.normal(size=(5, 5))
    paths = []

    def walk(at, last, score, used):
        if at == 4:
            paths.append((score, used))
            return
        walk(at + 1, 0, score + crf.moves[last, 0], used)
        for k, (i, j) in enumerate(spans):
            if i == at:
                for y in range(1, 5):
                    walk(j, y, score + crf.moves[last, y] + scores[k, y], [*used, (k, y)])

    walk(0, 0, 0.0, [])
    z = np.exp([s for s, _ in paths])
    expect = np.zeros((4, 5))
    for p, (_, used) in zip(z / z.sum(), paths, strict=True):
        for k, y in used:
            expect[k, y] += p
    assert np.allclose(crf._expected(4, spans, scores)[0], expect)
    best = max(paths)[1]
    assert [(spans[k][0], spans[k][1], y) for k, y in best] == crf._best(4, spans, scores)


def test_many_spans_take_linear_time():
    """Base and added spans by the thousand: each added one is held against what is near it only."""
    text = "write a.b@c.de or call 743-555-3824 now, jo (at) anmita (dot) info\n" * 3000
    base = pii.base_spans(text)
    added = pii.added_spans(text, pii.trained(), base)
    assert len(base) == 3000 and len(added) >= 3000
    spans = sorted((a, b) for _, a, b in base + added)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_personal_data_query(spark):
    texts = [None, "", "mail a.b@c.de now", "write to jo (at) anmita (dot) info or call 743-555-3824 ok", "é" * 50_000 + " 10.1.2.3"]
    got = table(pii.digest(pii.find(docs_of(spark, texts))))
    assert got[0][1:] == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "") == got[1][1:]
    assert got[2][1:] == (1, 0, 0, 0, hashlib.sha256(b"email:5:13").hexdigest(), "email:5:13")
    assert got[3][6].startswith("email:9:") and "phone:" in got[3][6] and got[3][5] == got[0][5]
    assert got[4][6] == "ip:50001:50009"
    assert pii.find(docs_of(spark, texts).limit(0)).count() == 0


# 2


def test_toxicity_gradient_and_accuracy():
    net = toxicity.Network()
    r = np.random.default_rng(3)
    for k, p in net.p.items():
        net.p[k] = p.astype(float)
    x, index = r.normal(size=(9, toxicity.INPUTS)), r.integers(0, 9, (3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    loss = lambda: (np.log1p(np.exp(-(2 * y - 1) * net.logits(net.projected(x), index, mask))) * w).sum() / w.sum()
    g, dx = net.gradient(x, index, mask, y, w)
    step = 1e-3  # the states are of single precision
    for name in ("xf", "ub", "a", "v", "o", "bb"):
        at = (0,) * net.p[name].ndim
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        assert abs((up - loss()) / (2 * step) - g[name][at]) < 3e-4, name
        net.p[name][at] += step
    x[index[0, 2], 1] += step
    up = loss()
    x[index[0, 2], 1] -= 2 * step
    assert abs((up - loss()) / (2 * step) - dx[index[0, 2], 1]) < 3e-4


def make_toxic(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        text = prose(r, r.choice([5, 30, 120]))
        if k % 3 == 0:
            parts = text.split()
            for _ in range(r.randint(1, 3)):
                parts.insert(r.randrange(len(parts) + 1), r.choice(["zlorp", "grunt" + r.choice(WORDS), "fnarg"]))
            text = " ".join(parts)
        out.append((text, int(k % 3 == 0)))
    return out


def test_toxicity_held_out(spark):
    train, test = make_toxic(400, 1), make_toxic(200, 2)
    net = toxicity.Network().fit([t.encode() for t, _ in train], [y for _, y in train], 0.3)
    got = net.scores([t.encode() for t, _ in test])
    assert np.mean((got >= 0.5) == [y for _, y in test]) > 0.95
    scored = table(toxicity.score(docs_of(spark, [None, "", test[0][0], "x " * 30_000]), net).select("doc_id", "score"))
    assert scored[0][1] == scored[1][1] and all(0 <= s <= 1 for _, s in scored.values()) and abs(scored[2][1] - got[0]) < 1e-6
    one = toxicity.Network().fit([b"only"], [0], 0.1)
    assert one.scores([b"anything", b""]).max() < 0.5


def test_training_rows_and_query(spark, tmp_path):
    """No held-out row is learned from; labels that are missing, repeated or contradict each other; the query on whole tables."""
    from sextant.llm.queries import op2_toxicity

    made = make_toxic(300, 4)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)] + [(0, made[0][0]), (900, None), (901, ""), (None, "no id"), (902, "y" * 300_000)], "doc_id long, text string")
    known = [(k, y) for k, (_, y) in enumerate(made)] + [(7, 1), (7, 0), (8, None), (None, 1), (900, 0), (902, 1), (5000, 1)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    out_of = {k for k in range(6000) if zlib.crc32(str(k).encode()) % 5 == 0}
    texts, y, rate = toxicity.training_rows(docs, labels, toxic=500, other=1000)
    allowed = {t.encode(): v for k, (t, v) in enumerate(made) if k not in out_of}
    assert set(texts) - {b""} <= set(allowed) and len(texts) == len(set(texts)) + texts.count(b"") - (b"" in texts) and 0.2 < rate < 0.5
    assert all(v == allowed[t] for t, v in zip(texts, y, strict=True) if t and t != made[7][0].encode()) and 7 not in out_of and dict(zip(texts, y, strict=True))[made[7][0].encode()] == 1
    few, _, _ = toxicity.training_rows(docs, labels, toxic=9, other=11)
    assert len(few) <= 20 and set(few) <= set(texts)
    assert toxicity.training_rows(docs, labels.limit(0), toxic=9, other=9)[:2] == ([], [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = op2_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.held_out} == out_of & {r.doc_id for r in rows} and [r.held_out for r in rows if r.doc_id is None] == [None]
    assert np.mean([(r.predicted == made[r.doc_id][1]) for r in rows if r.held_out and r.doc_id < 300]) > 0.9


def test_every_window_is_scored():
    index, mask, bag = toxicity.windows([np.arange(n) for n in (0, 1, 48, 49, 200)])
    for k, n in enumerate((0, 1, 48, 49, 200)):
        seen = {int(w) for row, m in zip(index[bag == k], mask[bag == k], strict=True) for w, on in zip(row, m, strict=True) if on}
        assert seen == set(range(n)) and (bag == k).sum() >= 1


# 3


def test_edit_distance():
    r = random.Random(5)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a, b = (bytes(r.choices(b"abc", k=r.randint(0, 14))) for _ in range(2))
        assert line_dedup.distance(a, b) == slow(a, b)


def words_of_lines(text):
    """The words of each line, lower case, punctuation as white space."""
    return [re.findall(rb"[0-9a-z\x80-\xff]+", line) for line in re.sub(rb"[A-Z]", lambda m: m[0].lower(), text).split(b"\n")]


def test_lines_as_arrays():
    r = random.Random(17)
    for _ in range(200):
        texts = ["".join(r.choices(["a", "B c", "é", " ", ".", "\n", "\r\n", "word of, words", "x" * 30], k=r.randint(0, 12))).encode() for _ in range(r.randint(1, 5))]
        lines = line_dedup.Lines(texts)
        owner, number = lines.of_texts(texts)
        want = [(t, k, line) for t, x in enumerate(texts) for k, line in enumerate(words_of_lines(x)) if line]
        assert list(zip(owner.tolist(), number.tolist(), lines.sizes.tolist(), lines.bytes.tolist(), strict=True)) == [(t, k, len(w), len(b" ".join(w))) for t, k, w in want]
        for k, (_, _, w) in enumerate(want):
            at = lines.starts[lines.first[k]]
            assert bytes(lines.buffer[at : at + lines.bytes[k]]).replace(b"\n", b" ").split() == w
        if want:
            key, sim = line_dedup.signatures(lines)
            for a in range(len(want)):
                for b in range(a):
                    assert (key[a] == key[b]) == (want[a][2] == want[b][2]) and (sim[a] == sim[b] or want[a][2] != want[b][2])


def slow_lines(texts):
    """Links between all pairs of distinct lines by edit similarity alone, one occurrence for each component."""
    first = {}
    for d, t in enumerate(texts):
        for k, line in enumerate(words_of_lines((t or "").encode())):
            if line:
                first.setdefault(tuple(line), (d, k))
    keys = list(first)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if line_dedup.alike(b" ".join(a), b" ".join(b)):
                root[top(a)] = top(b)
    keep = {}
    for k in keys:
        keep[top(k)] = min(keep.get(top(k), first[k]), first[k])
    return {(d, k) for d, t in enumerate(texts) for k, line in enumerate(words_of_lines((t or "").encode())) if line and keep[top(tuple(line))] != (d, k)}


def test_lines_against_all_pairs(spark):
    r = random.Random(8)
    pool = [prose(r, r.randint(1, 40)) for _ in range(60)]
    for line in pool[:20]:
        parts = line.split()
        parts[r.randrange(len(parts))] += r.choice("aeiou")
        pool.append(" ".join(parts))
    texts = ["\n".join(r.choice(pool) + r.choice(["", ".", "!"]) for _ in range(r.randint(0, 9))) for _ in range(60)] + [None, "", "\n\n", pool[0] + "\n" + pool[0], "?!\n?!"]
    gone = {tuple(x) for x in line_dedup.repeated_lines(docs_of(spark, texts)).collect()}
    assert gone == slow_lines(texts)
    done = {x.doc_id: x for x in line_dedup.deduplicate(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        assert done[d].text == left
    assert done[61].n_lines == 1 and done[60].n_lines == 0
    assert line_dedup.deduplicate(docs_of(spark, texts).limit(0)).count() == 0


def test_lines_alike_meet(spark):
    """Copies with a letter more in one word or with another word, against the edit similarity alone, without buckets and SimHash."""
    r = random.Random(12)
    texts, want = [], set()
    for _ in range(400):
        line = prose(r, r.randint(4, 60)).split()
        copy = list(line)
        at = r.randrange(len(copy))
        copy[at] = copy[at] + r.choice("aeiou") if r.random() < 0.5 else prose(r, 1)
        if copy != line and line_dedup.alike(" ".join(line).encode(), " ".join(copy).encode()):
            want.add((len(texts) + 1, 0))
        texts += [" ".join(line), " ".join(copy)]
    gone = {tuple(x) for x in line_dedup.repeated_lines(docs_of(spark, texts)).collect()}
    assert len(want) > 300 and len(gone & want) >= 0.99 * len(want)
    assert all(texts[d] == texts[d - 1] for d, _ in gone - want)


def test_lines_of_few_words_meet(spark):
    """Lines without spaces, as Chinese, Japanese or Thai have them, and lines of one to three words, against the edit similarity alone."""
    r = random.Random(5)
    sign = lambda: chr(r.choice([0x4E00, 0x0E01, 0x3042]) + r.randrange(40))
    texts, want = [], set()
    for k in range(600):
        line = [sign() for _ in range(r.randint(10, 90))] if k % 2 else list(prose(r, r.randint(1, 3)))
        copy = list(line)
        for _ in range(r.randint(1, 3) if k % 2 else 1):
            at = r.randrange(len(copy))
            copy[at : at + r.randint(0, 1)] = sign() if k % 2 else r.choice("aeiou ")
        line, copy = "".join(line), "".join(copy)
        a, b = (b" ".join(w[0]) for w in (words_of_lines(x.encode()) for x in (line, copy)))
        if a != b and line_dedup.alike(a, b):
            want.add((len(texts) + 1, 0))
        texts += [line, copy]
    gone = {tuple(x) for x in line_dedup.repeated_lines(docs_of(spark, texts)).collect()}
    assert len(want) > 250 and len(gone & want) >= 0.96 * len(want), [(texts[d - 1], texts[d]) for d, _ in want - gone]


def test_what_is_left_without_one_byte():
    held = np.frombuffer(b"abcdebcde", np.uint8)
    whole, rest = line_dedup.without_one(held[None, :5])[0], line_dedup.without_one(held[None, 5:])[0]
    assert rest[0] == whole[1] and len({*whole.tolist(), *rest.tolist()}) == 6 + 5 - 1


def test_band_equals_edit_distance():
    r = random.Random(15)
    texts = []
    for n in (1, 3, 20, 60, 200, 310, 320, 700, 1300, 2700):
        for _ in range(30):
            line = r.choices(b"abcde ", k=n)
            copy = list(line)
            for _ in range(r.randint(0, int(n * 0.13) + 1)):
                at = r.randrange(len(copy) + 1)
                copy[at : at + r.randint(0, 1)] = r.choices(b"abcdefg", k=r.randint(0, 1))
            texts += [bytes(line), bytes(copy)]
    i = np.arange(0, len(texts), 2)
    got = line_dedup.alike_pairs(texts, i, i + 1)
    assert got.tolist() == [line_dedup.alike(texts[k], texts[k + 1]) for k in i.tolist()] and 0.3 < got.mean() < 1


def partition(n, links):
    """The sets of more than one member that the links make of 0..n-1."""
    root = list(range(n))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in links:
        root[top(a)] = top(b)
    groups = {}
    for k in range(n):
        groups.setdefault(top(k), set()).add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_lines_of_one_bucket(spark, monkeypatch):
    """In buckets of 2,000 lines all alike pairs are connected, and no others, also where a bucket is dealt to several tasks and runs over batches."""
    r = random.Random(21)
    bases = [prose(r, 7)[:32].strip() for _ in range(300)]
    lines = set()
    while len(lines) < 2000:
        line = list(r.choice(bases))
        for _ in range(r.randint(0, 5)):
            line[r.randrange(len(line))] = r.choice("aeiourn")
        lines.add("".join(line))
    lines = sorted(x.encode() for x in lines)
    n = len(lines)
    i, j = np.triu_indices(n, 1)
    alike = line_dedup.alike_pairs(lines, i, j)
    want = partition(n, zip(i[alike].tolist(), j[alike].tolist(), strict=True))
    assert len(want) > 20 and max(map(len, want)) > 5
    zeros, sizes = np.zeros(n, np.int64), -np.array([len(x) for x in lines])
    a, b = line_dedup.spanning(zeros, np.arange(n), zeros, sizes, lines, 0.9)
    assert len(a) < n and partition(n, zip(a.tolist(), b.tolist(), strict=True)) == want
    monkeypatch.setattr(line_dedup, "PART", 300)
    monkeypatch.setattr(line_dedup, "HELD_ROWS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        rows = [(block, k, 0, int(sizes[k])) for block, own in ((1, range(n)), (2, range(50)), (3, range(3)), (4, [7])) for k in own]
        found = line_dedup._candidates(spark.createDataFrame(rows + rows[:500], "block long, key long, sim long, size int"), 0.9)
        assert found.where("part is not null").select("block").distinct().count() == 1
        texts = spark.createDataFrame(list(enumerate(lines)), "key long, words binary")
        got = [tuple(x) for x in line_dedup._linked(found.withColumn("root", F.col("key")), texts, 0.9).collect()]
        starred = {tuple(x) for x in line_dedup._starred(found, texts, 0.9).collect()}
        pairs = [(r[0], r[1]) for r in rows]
        shared = sorted(tuple(x) for x in line_dedup._shared(spark.createDataFrame(pairs + pairs[:500], "block long, key long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert partition(n, got) == want
    assert starred <= set(zip(i[alike].tolist(), j[alike].tolist(), strict=True)) and starred
    assert shared == sorted(p for p in pairs if p[0] != 4)


# 4


def test_banded_alignment():
    r = random.Random(4)
    for _ in range(800):
        a = np.array(r.choices(range(6), k=r.randint(0, 25)), np.uint64)
        b = np.array([x for x in a if r.random() > 0.1] + r.choices(range(6), k=r.randint(0, 2)), np.uint64)
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(row[j], new[-1], row[j - 1] + (x == y)))
            row = new
        c, n = row[-1], len(a) + len(b)
        got = near_dedup.similarity(a, b)
        want = c / (n - c) if n else 0.0
        assert (got >= 0.8) == (want >= 0.8) and (got < 0.8 or got == want)


def near_copies(r, base, n, edits):
    out = []
    for _ in range(n):
        parts = base.split()
        for _ in range(r.randint(0, edits)):
            parts[r.randrange(len(parts))] = r.choice(WORDS) + "x"
        out.append(" ".join(parts))
    return out


def common_words(a, b):
    """The longest common subsequence, by its table."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        hit = np.array([x == y for y in b], bool)
        new = np.maximum(row[1:], np.where(hit, row[:-1] + 1, 0))
        row = np.concatenate(([0], np.maximum.accumulate(new)))
    return int(row[-1])


def slow_classes(texts):
    """All pairs by words in the same order, over all words."""
    split = [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            a, b = split[i], split[j]
            same = a == b and (bool(a) or (texts[i] or "") == (texts[j] or ""))
            bag, n = sum((Counter(a) & Counter(b)).values()), len(a) + len(b)
            if same or a and b and bag >= 0.8 * (n - bag) and (c := common_words(a, b)) >= 0.8 * (n - c):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in range(len(texts))}


def test_near_copies_against_all_pairs(spark):
    r = random.Random(12)
    texts = [prose(r, r.choice([1, 3, 6, 12, 30, 100, 300])) for _ in range(60)]
    for n, size in ((40, 150), (3, 60), (6, 12), (2, 400)):
        base = prose(r, size)
        texts += [base, *near_copies(r, base, n, max(1, size // 60))]
    texts += [texts[0], texts[1].upper(), None, "", "", "?!", "?!", prose(r, 3000)]
    passage = prose(r, 40)
    texts += [prose(r, 60) + " " + passage for _ in range(30)]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    got = table(near_dedup.classes(docs_of(spark, texts)))
    assert {k: v[1] for k, v in got.items()} == slow_classes(texts)
    kept = near_dedup.deduplicate(docs_of(spark, texts)).select("doc_id").collect()
    assert {x.doc_id for x in kept} == set(slow_classes(texts).values())
    assert near_dedup.classes(docs_of(spark, texts).limit(0)).count() == 0


def test_looser_copies_and_large_buckets(spark, monkeypatch):
    """Copies with one word in twenty changed; and members of buckets that are dealt to several tasks, all of which meet."""
    r = random.Random(14)
    texts = []
    for _ in range(60):
        base = prose(r, r.choice([60, 150, 400])).split()
        copy = [w if r.random() > 0.05 else r.choice(WORDS) + "x" for w in base]
        texts += [" ".join(base), " ".join(copy)]
    got = {x.doc_id: x.class_id for x in near_dedup.classes(docs_of(spark, texts)).collect()}
    pairs = [k for k in range(0, len(texts), 2) if near_dedup.similarity(np.array([hash(w) for w in texts[k].split()]), np.array([hash(w) for w in texts[k + 1].split()])) >= 0.8]
    assert len(pairs) > 50 and sum(got[k] == got[k + 1] for k in pairs) >= 0.95 * len(pairs) and len(set(got.values())) >= 60
    monkeypatch.setattr(near_dedup, "PART", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        chain = [[f"w{k}" for k in range(60)]]
        for step in range(80):  # each is like the one before and, in the end, unlike the first
            chain.append([w if k % 20 != step % 20 else f"v{step}" for k, w in enumerate(chain[-1])])
        numbers = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in chain]
        order = list(range(len(chain)))
        r.shuffle(order)
        rows = spark.createDataFrame([(7, order[k], k, 60, len(chain)) for k in range(len(chain))] + [(8, 500 + k, 500 + k, 60, 2) for k in range(2)], "bucket long, doc_id long, root long, n int, size long")
        words_ = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(numbers)] + [(500 + k, numbers[50 * k].tobytes()) for k in range(2)], "doc_id long, hashes binary")
        found = [tuple(x) for x in near_dedup._connected(rows, words_, 0.8).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert partition(600, found) == {frozenset(range(len(chain)))}


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(5, 3), (3, 5), (7, 7), (100, 50), (100, 60)]
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 10) for k in range(10, 41)} | {(5, 3), (3, 3), (100, 50), (50, 50), (60, 50)}


# 5


def test_audio_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "b" * 577, prose(random.Random(1), 4000)]
    rows = {x.doc_id: x for x in media.audio_columns(docs_of(spark, texts)).collect()}
    digest = {x.doc_id: x for x in media.digest(media.audio_columns(docs_of(spark, texts))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(media.from_wav(bytes(rows[k].media))) == payload and rows[k].n_bytes == len(raw)
        d = digest[k]
        assert (d.payload_bytes, d.payload_sha256, d.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (d.media_bytes, d.media_sha256) == (len(rows[k].media), hashlib.sha256(rows[k].media).hexdigest())
        stored = media.from_tensors(bytes(rows[k].tensors))
        assert isinstance(stored.schema.field("log_mel").type, pa.FixedShapeTensorType) and stored.schema.field("log_mel").type.shape == [media.CHUNK, media.MELS]
        assert stored["end_ms"][-1].as_py() <= 1000 * len(payload) / media.RATE + 1
    assert digest[0].feature == digest[1].feature


def test_resampling_and_bands():
    t = np.arange(57_600) / media.RATE
    tone = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    down = media.resample(tone)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(down)) / 6000)
    shift = max(range(-4, 5), key=lambda s: np.dot(down[100:-100], np.roll(want, s)[100:-100]))
    assert len(down) == len(tone) * 3 // 4 and np.corrcoef(down[100:-100], np.roll(want, shift)[100:-100])[0, 1] > 0.9
    mel = media.log_mel(down)
    assert media.MEL[:, mel.mean(0).argmax()][int(1000 / 6000 * 256)] > 0
    quiet = np.concatenate([tone[:5760] * 0.01, tone[:5760], tone[:5760] * 0.01])
    found = media.segments(media.log_mel(media.resample(quiet)))
    assert len(found) >= 1 and all(30 <= (a + b) / 2 <= 90 for a, b in found)


# 6


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_and_model(spark):
    r = random.Random(2)
    made = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://org/", "x://a.com?/fr/", "http://x.com?u=https://y.com/de/z", "http://x.com#https://y.com/de/z", "http://x.com/fr/?u=https://y.com/de/z", "http://x.com/de/\n", "//a://b.com/de/://c.org/", "http://notexample.org/es/", "http://é.com/de/\nx", "a://b://c.com/fr/1"]
    made += [f"http{r.choice(['', 's'])}://{r.choice(['', 'www.', 'A.'])}{r.choice(['example.org', 'org', 'x.com', 'com', 'y.net'])}{r.choice(['', '/', '/es/', '/en/1', '/en/2', '/fr/', '/de/q'])}{r.choice(['', '?a=1', '#t'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string").selectExpr("*", "'x' as host")
    got = {x.page_id: x for x in urls.judge(pages).collect()}
    for k, u in enumerate(made):
        host, path, rule, verdict = slow_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == (verdict or ("block" if got[k].score >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0)).count() == 0
    held = urls.made_urls(600, seed=77)
    trained = urls.made_urls(2000)
    model = urls.UrlModel().fit([u for u, _ in trained], [y for _, y in trained])
    assert np.mean((model.scores([u for u, _ in held]) >= 0.5) == [y for _, y in held]) > 0.95


# 7


def test_decontamination_against_all_windows(spark):
    r = random.Random(9)
    words = ["w%d" % k for k in range(6)]
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 3, 9, 10, 11, 25])))) for k in range(25) if k % 5] + [(100, None), (101, ""), (102, "?!"), (103, "É x"), (2, "dup id " + " ".join(words * 3))]
    texts = [" ".join(r.choices(words + ["É", "x", "Q"], k=r.choice([0, 2, 12, 60]))) for _ in range(80)] + [None, "", "é X", "É, X!"]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute(list(enumerate(texts)), items)
    for block in (32 << 20, 200):
        got = table(decontaminate.digest(decontaminate.match_items(docs, bench, block_bytes=block)))
        assert {k: v[1:] for k, v in got.items()} == want
    assert decontaminate.match_items(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    long = spark.createDataFrame([(0, " ".join(f"q{k}" for k in range(12)))], "item_id long, text string")
    mixed = docs_of(spark, ["clean text", "before words " + " ".join(f"Q{k}," for k in range(12)) + " and after that " + "more " * 20, " ".join(f"q{k}" for k in range(12)), None])
    left = {x.doc_id: x.text for x in decontaminate.decontaminate(mixed, long).collect()}
    assert left[0] == "clean text" and left[3] is None and 2 not in left and "Q5" not in left[1] and left[1].startswith("before words") and "and after" in left[1]


# 8


def test_packing_keeps_every_id_once(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(3)
    texts = [None, "", "It's Über-cool, isn't it...", "a\u00a0b\x01c <|endoftext|> İI ΑΣ \u1e9e", "a <|endoftext|> b.<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof\ntext|> é<|endoftext|>.", "<|endoftext|>", "x" * 5000] + [prose(r, r.choice([1, 10, 200, 3000])) for _ in range(60)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in enumerate(texts)}
    for last in (200_000, 40):
        monkeypatch.setattr(packing, "LAST", last)
        rows = packing.pack(docs_of(spark, texts), keep_ids=True).collect()
        at, sequences = Counter(), {}
        for x in sorted(rows, key=lambda x: (x.doc_id, x.start)):
            own = want[x.doc_id][x.start : x.start + x.length]
            assert x.start == at[x.doc_id] and len(own) == x.length and x.doc_tokens == len(want[x.doc_id])
            raw = struct.pack(f"<{len(own)}I", *own)
            assert x.ids_crc32 == zlib.crc32(raw) and bytes(x.ids) == raw
            at[x.doc_id] += x.length
            sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
        assert all(at[k] == len(v) for k, v in want.items())
        for found in sequences.values():
            total = 0
            for offset, length in sorted(found):
                assert offset == total
                total += length
            assert total <= 2048
    assert packing.padding(packing.pack(docs_of(spark, texts))).first().padding < 0.1
    assert packing.pack(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 700, 1023, 1024, 1025, 1593, 2047, 2048, 2049, 10_000])
def test_cuts(n):
    found = packing.cuts(n, 2048, 0.03)
    assert sum(found) == n and all((2048 // x) * x >= 0.97 * 2048 for x in found)


# 9


def test_repeats_against_all_strings(spark):
    r = random.Random(6)
    passage = [prose(r, 40) for _ in range(4)]
    texts = [prose(r, r.choice([1, 20, 100])) for _ in range(30)]
    texts += [prose(r, r.randint(0, 30)) + r.choice(passage)[r.randint(0, 40) :] + prose(r, r.randint(0, 30)) for _ in range(40)]
    texts += [texts[5], texts[5], None, "", "Nd " * 200, "ab" * 300, "é" * 120, texts[35] + texts[35], "x" * 99, "x" * 100, "x" * 101]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    want = substrings.brute(list(enumerate(texts)))
    docs = docs_of(spark, texts).repartition(3)
    for split, shard in ((40_000, 3 << 20), (3, 4_000)):
        got = {x.doc_id: x for x in substrings.remove_repeats(docs, split=split, shard=shard).collect()}
        for k, (n, removed, spans, kept) in want.items():
            x = got[k]
            assert (x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), bytes(x.kept)) == (n, removed, spans, kept), (k, split)
    twice = docs.union(docs)
    assert {(x.doc_id, bytes(x.kept)) for x in substrings.remove_repeats(twice).collect()} == {(k, v[3]) for k, v in want.items()}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_one_anchor_over_several_shards(spark):
    """A passage that more documents have than one shard takes, at the default sizes: what its parts have left is merged."""
    r = random.Random(10)
    passage = prose(r, 60)[:130]
    letters = "abcdefghij"
    texts = ["".join(r.choices(letters, k=35)) + passage + "".join(r.choices(letters, k=35)) for _ in range(substrings.SPLIT + 2_000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spot int").repartition(2)
    parts = substrings._repeated(substrings._anchored(docs, "text"), substrings.SPLIT).where("split").groupBy("anchor").agg(F.max("part").alias("part"))
    assert parts.agg({"part": "max"}).first()[0] == 1
    seen, want = set(), {}
    for k, t in enumerate(x.encode() for x in texts):
        gone = end = 0
        for at in range(len(t) - 99):
            if (h := hash(t[at : at + 100])) in seen:
                gone += at + 100 - max(end, at)
                end = at + 100
            seen.add(h)
        want[k] = gone
    assert table(substrings.digest(substrings.remove_repeats(docs)).select("doc_id", "n_removed")) == {k: (k, v) for k, v in want.items()}


def test_merging_sorted_runs():
    r = random.Random(11)
    for _ in range(60):
        places = r.sample(range(200), 60)
        runs, everything = [], []
        for k in range(r.randint(1, 7)):
            strings = sorted(r.sample([b"%02d" % x for x in range(20)], r.randint(0, 8)))
            own = [(s, places.pop(), 7) for s in strings]
            everything += own
            runs.append((np.array([s for s, _, _ in own], "S16"), np.array([d for _, d, _ in own], np.int64), np.array([p for _, _, p in own], np.int64)))
        first = {}
        for s, d, _ in sorted(everything, key=lambda x: x[1]):
            first.setdefault(s, d)
        doc, _ = substrings.merge_runs(runs)
        assert sorted(doc.tolist()) == sorted(d for s, d, _ in everything if d != first[s])


def test_long_texts_in_parts(monkeypatch):
    r = random.Random(2)
    text = (prose(r, 300) + " " + prose(random.Random(99), 60)).encode()
    whole = substrings.anchors(*next(substrings._parts([1], [text])))
    monkeypatch.setattr(substrings, "PART", 500)
    parts = [substrings.anchors(*x) for x in substrings._parts([1], [text])]
    starts = lambda made: sorted(s for m in made for o, c in zip(m[3].tolist(), m[4].tolist(), strict=True) for s in range(o, o + c))
    assert starts([whole]) == starts(parts) == list(range(len(text) - 99))


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for _ in range(20):
        texts = [bytes(r.choice(list(b"ab"), r.integers(1, 60)).astype(np.uint8)) for _ in range(5)]
        raw = b"".join(texts)
        order, _ = substrings.suffix_array(np.frombuffer(raw, np.uint8))
        assert [raw[i : i + 128] for i in order] == sorted(raw[i : i + 128] for i in range(len(raw)))
        lengths = np.array([len(t) for t in texts])
        got = substrings.common_prefixes(np.frombuffer(raw, np.uint8), order, np.cumsum(lengths) - lengths, lengths)
        for k in range(1, len(raw)):
            a, b, n = raw[order[k - 1] :], raw[order[k] :], 0
            while n < min(len(a), len(b), 100) and a[n] == b[n]:
                n += 1
            assert got[k] == n


# 10


def test_blocks():
    page = "<head><title>T</title></head><body><!-- x<p> --><script>var a='</p>'</script><p>A &amp; b<br>c<b>d</b><p>two<ul><li>i<li>j</ul><div>x < y &copy; <a href='>'>link</a></div><p>cut <tag att"
    assert [(p.tag, t) for p, t, _ in html_text.blocks(page)] == [("p", "A & b cd"), ("p", "two"), ("li", "i"), ("li", "j"), ("div", "x < y © link"), ("p", "cut")]
    assert html_text.blocks("") == [] and html_text.blocks("<" * 5000)[0][1] == "<" * 5000
    html_text.blocks("<!--" * 20_000 + "<a " * 20_000 + "<script>" * 20_000)
    kept = "<article><p>sum <math><mi>x</mi></math> of <object data=a>an image</object></p><iframe src=b><p>after it</article>"
    assert [t for _, t, _ in html_text.blocks(kept)] == ["sum x of an image", "after it"]


def test_deep_and_long_pages():
    """100,000 nested tags and a million blocks: time and memory in proportion to the page."""
    import resource

    for inner in ("<div>x", "<ul><li>x", "<b>x<li></li>", "<div class=a>x", "<p><span>x"):
        page = inner * 100_000 + "</div></li></ul></span>" * 100_000
        assert sum(len(t) for _, t, _ in html_text.blocks(page)) >= 100_000
    net = html_text.BiLSTM()
    made = html_text.blocks("<div><p>a bc<p class=x>d.</div>" * 60)
    x, mask, _ = html_text.padded([(html_text.features(made), np.zeros(len(made)))])
    assert np.allclose(net.scores(x, mask)[0], net._long(made, 17), atol=1e-5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = html_text.blocks("<p>a" * 1_000_000)
    assert len(found) == 1_000_000 and len(net.labels([found])[0]) == 1_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_lstm_gradient_and_accuracy():
    net = html_text.BiLSTM()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, mask, y = r.normal(size=(2, 4, html_text.INPUTS)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float), np.array([[1, 0, 1, 1], [0, 1, 0, 0]], float)
    _, g = net.gradient(x, mask, y)
    for name in ("xf", "hb", "cf", "o", "ob"):
        at = (0,) * net.p[name].ndim
        net.p[name][at] += 1e-5
        up = net.gradient(x, mask, y)[0]
        net.p[name][at] -= 2e-5
        assert abs((up - net.gradient(x, mask, y)[0]) / 2e-5 - g[name][at]) < 1e-4, name
        net.p[name][at] += 1e-5
    pages = html_text.make_pages(150, 4321)
    got = html_text.trained().labels([p for p, _ in pages])
    assert np.mean(np.concatenate(got) == (np.concatenate([y for _, y in pages]) > 0.5)) > 0.97


def test_extraction(spark):
    page = "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=ad>Buy it now.</div><article><h1>Über uns</h1><p><b>One&nbsp; &lt;two&gt;.<br><p>Three is a long sentence of many words here.</p></article><footer>&copy; me</footer>"
    pages = spark.createDataFrame([(1, "u", page, 7), (2, None, None, 7), (3, "u", "", 7), (4, "u", "<nav>a</nav>", 7)], "page_id long, url string, html string, n_chars int")
    got = table(html_text.extract(pages))
    text = "Über uns\nOne <two>.\nThree is a long sentence of many words here."
    assert got[1] == (1, "u", text, len(text)) and got[2] == (2, None, "", 0) and got[3][2] == "" and got[4][2] == ""
    assert html_text.extract(pages.limit(0)).count() == 0
