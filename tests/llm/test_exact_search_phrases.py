"""Exact duplicates, ranked search and phrase mining against brute force, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import exact_dedup, phrases, ranked_search

SYLLABLES = "an be cor da el fin go hal is jo ka lem".split()


def prose(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 2))) for _ in range(n))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11


def slow_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[lowered(t)]
        known = [x for x in own if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    return sorted(out, key=str)


def texts_with_copies(r):
    base = [prose(r, r.randint(0, 30)) for _ in range(40)] + ["", None, "É", "é", "ÀB", "Àb", "x" * 300_000]
    rows = [(i, t if t is None or r.random() < 0.5 else t.upper() if t.isascii() else t) for i, t in enumerate(r.choices(base, k=300))]
    rows += [(1000 + i, "Hot Text") for i in range(200)]
    return [*rows, (5, base[0]), (5, base[0]), (None, base[1]), (None, "alone without an id")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_copies(spark, monkeypatch, weak):
    """With a digest of one digit, most of which have several contents, groups still are those of equal texts."""
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 5)
    rows = texts_with_copies(random.Random(11))
    docs = spark.createDataFrame([(*x, "k", 7) for x in rows], "doc_id long, text string, keep_id string, group_size int").repartition(5)
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 1)) if weak else exact_dedup.sha256
    got = [tuple(x) for x in exact_dedup.find(docs, digest=digest).collect()]
    want = slow_groups(rows)
    assert sorted([x[:4] for x in got], key=str) == [x[:4] for x in sorted(want, key=lambda x: str(x[:4]))]
    if not weak:
        assert sorted(got, key=str) == want


def test_exact_copies_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "a"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.text) for x in exact_dedup.deduplicate(docs).collect()) == [(0, "a"), (2, "A"), (3, "b"), (5, "")]
    assert exact_dedup.find(docs.limit(0)).collect() == []


def test_exact_copies_run_no_python(spark):
    plan = exact_dedup.find(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 12


def slow_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(x for x in scored if x[0])[:k], 1)]
    return sorted(out, key=str)


def search_case(r):
    docs = [(i, prose(r, r.randint(0, 60))) for i in range(400)]
    items = [("a", prose(r, 12)), ("b", docs[3][1]), ("c", None), ("d", "..."), ("e", "unheard"), ("a", "an an be"), (None, "hal IS hal")]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (900, ""), (901, "über Über ÜBER"), (902, "long " + prose(r, 20_000))]
    return docs, [*items, ("f", docs[7][1] + " über")]


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_search_against_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "TREE_ROWS", 256)
    docs, items = search_case(random.Random(12))
    d = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, score string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, rank int")
    got = ranked_search.search(d, i, k=9, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_search(docs, items, 9)
    if block > 50:
        assert ranked_search.search(d.limit(0), i).collect() == [] and ranked_search.search(d, i.limit(0)).collect() == []


def random_tree(r, rows, terms, leaders=None):
    code = [np.unique(r.choice(terms, r.integers(1, 12))) if leaders is None else np.unique(np.append(r.choice(leaders[k % len(leaders)], 9), r.integers(terms))) for k in range(rows)]
    ptr = np.concatenate([[0], np.cumsum([len(c) for c in code])])
    code = np.concatenate(code)
    weights = r.integers(0, 12_000, terms)
    return ptr, code, r.integers(1, 1_000_000, len(code)), weights, ranked_search.banded(np.bincount(code, minlength=terms), weights)


def test_bounds_hold_and_balls_are_left_out():
    r = np.random.default_rng(3)
    for rows, terms, leaders in ((1, 3, None), (700, 40, None), (1500, 300, [np.arange(k * 12, k * 12 + 12) for k in range(20)])):
        ptr, code, value, weights, band = random_tree(r, rows, terms, leaders)
        tree = ranked_search.BallTree(ptr, code, value, np.sqrt(weights), band)
        assert sorted(tree.order) == list(range(rows))
        scored = leaves = 0
        for k in range(25):
            asked, counts = np.unique(r.choice(terms if leaders is None else leaders[k % 20], 6), return_counts=True)
            exact = np.zeros(terms, np.int64)
            exact[asked] = weights[asked] * counts
            scores = np.add.reduceat(exact[code] * value, ptr[:-1])
            bound = tree.bounds(asked, counts)
            assert all(scores[tree.order[a:b]].max() <= x for (a, b), x in zip(tree.at, bound, strict=True))
            best = ranked_search.TopK(10, 0)
            best.ids = np.arange(rows)
            scored, leaves = scored + tree.search(asked, counts, weights, best), leaves + sum(not c for c in tree.children)
            top = np.lexsort((np.arange(rows), -scores))[:10]
            top = top[scores[top] > 0]
            assert best.id.tolist() == top.tolist() and best.score.tolist() == scores[top].tolist()
        assert leaders is None or scored < leaves / 5


# 13


def slow_phrases(docs, support, percent, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= support and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(q[i : i + len(p)] == p and 100 * b >= percent * a for (other, q), b in often.items() if other == lang and len(q) > len(p) for i in range(len(q))):
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def phrase_docs(r):
    out = []
    for _ in range(120):
        words = [r.choice(["the Old mill", "of of of", "river", "in the old mill pond", "É é", "x"]) if r.random() < 0.6 else prose(r, 1) for _ in range(r.randint(0, 40))]
        out.append((r.choice(["en", "en", "en", "de", None]), "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", " ", "\x1c"]) for w in words)))
    return [*out, ("en", None), ("fr", ""), ("fr", " .,! "), ("en", "no end no end " * 3000), ("de", "\x00 \x00 a")]


@pytest.mark.parametrize(("shard", "bits"), [(1 << 20, 28), (2000, 28), (2000, 14)])
def test_phrases_against_all_counts(spark, monkeypatch, shard, bits):
    """In one shard and in many; with a filter so small that it lets nearly everything through."""
    monkeypatch.setattr(phrases, "MOST_LOG", bits)
    monkeypatch.setattr(phrases, "FILTER_BITS", 16 if bits > 14 else 0)
    docs = phrase_docs(random.Random(13))
    df = spark.createDataFrame([(*x, 1, "n") for x in docs], "lang string, text string, rank int, n string").repartition(3)
    for support, percent, top in ((8, 100, 2000), (5, 60, 7)):
        got = phrases.mine(df, support=support, percent=percent, top=top, shard_bytes=shard)
        assert sorted(map(tuple, got.collect())) == slow_phrases(docs, support, percent, top)
    assert phrases.mine(df.limit(0)).collect() == []


def test_large_products_are_exact(spark):
    """1000 * a * n and l * r pass 64 bits, and a double's digits."""
    known = [("x", a, n, a + 7, a + 11) for a, n in ((10**11 + 1, 10**13 + 3), (3 * 10**9 + 7, 9 * 10**12 + 1))]
    df = spark.createDataFrame(known, "lang string, a long, n long, l long, r long")
    assert [r[0] for r in df.select(phrases.score()).collect()] == [1000 * a * n // (x * y) for _, a, n, x, y in known]
