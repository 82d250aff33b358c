"""Benchmark decontamination: the longest matches of document words in a generalised suffix automaton of the items."""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import WORD_BYTES, materialise, pieces, utf8, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Every substring of every item, by word number, in flat arrays: about 30 bytes for each word of the items.

    A state stands for the substrings of lengths ``length[link]+1`` to ``length`` that end at the same places. Most states have one
    next word: ``word`` and ``step``; further ones are ``more`` (state and word as one number, sorted) and ``more_step``, those of the
    start are ``root``. ``owner`` has the item whose window ends a match in that state (-1: none; -2 and less: ``several``, for windows
    of several items). ``short_at`` is the nearest state up the links in which an item of fewer words than a window ends (``short``).
    """

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        length, link, word, step, branches = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [0]), {0: {}}

        def get(p: int, c: int) -> int | None:
            if word[p] == c:
                return step[p]
            return branches[p].get(c) if p in branches else None

        def put(p: int, c: int, q: int) -> None:
            if p and word[p] in (-1, c):
                word[p], step[p] = c, q
            else:
                branches.setdefault(p, {})[c] = q

        def new(n: int, up: int) -> int:
            length.append(n)
            link.append(up)
            word.append(-1)
            step.append(0)
            return len(length) - 1

        def split(p: int, c: int, q: int) -> int:
            """A state for the substrings of q that are no longer than p's longest and c; p's transitions lead there."""
            clone = new(length[p] + 1, link[q])
            word[clone], step[clone] = word[q], step[q]
            if q in branches:
                branches[clone] = dict(branches[q])
            link[q] = clone
            while p >= 0 and get(p, c) == q:
                put(p, c, clone)
                p = link[p]
            return clone

        def extend(last: int, c: int) -> int:
            q = get(last, c)
            if q is not None:
                return q if length[q] == length[last] + 1 else split(last, c, q)
            own, p = new(length[last] + 1, 0), last
            while p >= 0 and get(p, c) is None:
                put(p, c, own)
                p = link[p]
            if p >= 0:
                q = get(p, c)
                link[own] = q if length[q] == length[p] + 1 else split(p, c, q)
            return own

        self.names, texts = [], []
        for item, text in items:
            numbers = array("i", [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)])
            if numbers:
                self.names.append(str(item))
                texts.append(numbers)
                last = 0
                for c in numbers:
                    last = extend(last, c)
        self.shortest = min((min(window, len(n)) for n in texts), default=0)
        self.length, self.link, self.word, self.step = (np.array(x, np.int32) for x in (length, link, word, step))
        self.root = np.zeros(len(self.vocabulary), np.int32)
        for c, q in branches.pop(0).items():
            self.root[c] = q
        further = np.fromiter((x for p, own in branches.items() for c, q in own.items() for x in (p << 32 | c, q)), np.int64).reshape(-1, 2)
        further = further[np.argsort(further[:, 0])]
        self.more, self.more_step = further[:, 0].copy(), further[:, 1].astype(np.int32)
        del length, link, word, step, branches, further
        self._owners(texts)

    def _owners(self, texts: list[array]) -> None:
        up = np.maximum(self.link, 0)
        n, least = len(up), self.length
        at = np.where(least >= self.window, np.where(least[up] < self.window, np.arange(n), up), 0).astype(np.int32)
        while not np.array_equal(nxt := at[at], at):
            at = nxt
        owner, several, short = np.full(n, -1, np.int32), {}, {}
        for k, numbers in enumerate(texts):
            state = 0
            for i, c in enumerate(numbers):
                state = self.next(state, c)
                if i + 1 >= self.window:
                    s = int(at[state])
                    if owner[s] == -1:
                        owner[s] = k
                    elif owner[s] != k:
                        several.setdefault(s, {int(owner[s])}).add(k)
            if len(numbers) < self.window:
                short.setdefault(state, (len(numbers), []))[1].append(k)
        self.several = []
        for s, who in several.items():
            self.several.append(tuple(sorted(who)))
            owner[s] = -1 - len(self.several)
        self.owner = np.where(at > 0, owner[at], -1)
        self.short, self.short_at = short, None
        if short:
            at = up.copy()
            own = np.fromiter(short, np.int64)
            at[own] = own
            while not np.array_equal(nxt := at[at], at):
                at = nxt
            self.short_at = at

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "views"}

    def __getattr__(self, name: str):
        """Views of the arrays, which give plain numbers faster."""
        if name != "views":
            raise AttributeError(name)
        self.views = tuple(memoryview(x) for x in (self.root, self.word, self.step, self.more, self.more_step, self.link, self.length))
        return self.views

    def next(self, state: int, c: int) -> int:
        """The state after one more word, 0 for none."""
        root, word, step, more, more_step, _, _ = self.views
        if not state:
            return root[c]
        if word[state] == c:
            return step[state]
        key = state << 32 | c
        k = bisect_left(more, key)
        return more_step[k] if k < len(more) and more[k] == key else 0

    def nbytes(self) -> int:
        """Bytes of the arrays."""
        return sum(x.nbytes for x in self.__dict__.values() if isinstance(x, np.ndarray))

    def matches(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The runs of words inside windows, as start and end, and the items whose windows occur."""
        runs: list[tuple[int, int]] = []
        found: set = set()
        if not self.shortest or len(tokens) < self.shortest:
            return runs, found
        numbers = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int64, len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers >= 0, [0])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        enough = ends - starts >= self.shortest
        root, word, step, _, _, link, length = self.views
        window, names, owner = self.window, self.names, self.owner
        for a, b in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            state = matched = 0
            for i, c in enumerate(numbers[a:b].tolist(), a):
                while state:
                    if nxt := step[state] if word[state] == c else self.next(state, c):
                        matched += 1
                        break
                    state = link[state]
                    matched = length[state]
                else:
                    nxt, matched = root[c], 1
                state = nxt
                reach = 0
                if matched >= window:
                    reach = matched
                    who = int(owner[state])
                    found.update([names[who]] if who >= 0 else (names[k] for k in self.several[-2 - who]))
                if self.short:
                    at = int(self.short_at[state])
                    while at:
                        n, who = self.short[at]
                        if n <= matched:
                            reach = max(reach, n)
                            found.update(names[k] for k in who)
                        at = int(self.short_at[link[at]])
                if reach:
                    start = i + 1 - reach
                    while runs and runs[-1][1] >= start:
                        start = min(start, runs.pop()[0])
                    runs.append((start, i + 1))
        return runs, found


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about ``block_bytes``, so that neither the driver nor a broadcast holds more of them at once."""
    items = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + int(total // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield [(r.item, bytes(r.text)) for r in part.collect()]


SPANS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _last(blocks: Iterator) -> Iterator[tuple]:
    """Each block, with whether it is the last; one ahead is held."""
    held = next(blocks)
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def match_items(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20, finish: Callable | None = None) -> DataFrame:
    """``docs`` with the runs of words that lie inside a window of some item: n_words, starts, ends, items.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty
    texts have no words and no runs; an empty table of items gives no runs. Columns of ``docs`` by the names of the result
    are replaced. Each row is matched by itself, so repeated rows give equal rows; repeated items, and items of one id, count once.
    The automaton of a block of items, of some 30 bytes a word, is broadcast; with more than ``block_bytes`` of items, the blocks pass
    over the documents one after the other, each adding to what the last has found. With ``finish``, the last of them gives what
    that function makes of the batch, its texts, and their numbers of words and runs, in the columns of ``docs``.
    """
    names = ("n_words", "starts", "ends", "items")
    out = docs if finish else docs.drop(*names)
    spark, kept = docs.sparkSession, out.columns
    for k, (block, last) in enumerate(_last(_blocks(items, item_id, item_text, block_bytes))):
        done = finish if last else None
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, first=k == 0, done=done) -> Iterator[pa.RecordBatch]:
            found = automaton.value
            for batch in pieces(batches, text):
                n_words, starts, ends, names_of = [], [], [], []
                before = None if first else [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
                values = utf8(batch.column(text))
                for i, value in enumerate(values):
                    tokens = words(value)
                    runs, hit = found.matches(tokens)
                    if before:
                        runs, hit = union(runs + list(zip(before[0][i], before[1][i], strict=True))), hit | set(before[2][i])
                    n_words.append(len(tokens))
                    starts.append([a for a, _ in runs])
                    ends.append([b for _, b in runs])
                    names_of.append(sorted(hit))
                if done:
                    yield done(batch.select(kept), values, n_words, starts, ends)
                    continue
                own = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names_of, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + own, names=[*kept, *names])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in kept)
        out = out.mapInArrow(run, fields if done else f"{fields}, {SPANS}")
        if not last:
            # what is found is written before the next block, so that a task holds one automaton, and so does the driver
            out = materialise(out)
            automaton.destroy()
    return out


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def cut_words(value: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without these runs of words and what stands between the words of a run."""
    spots = [m.span() for m in WORD.finditer(value.translate(WORD_BYTES))]
    kept, at = [], 0
    for a, b in runs:
        kept.append(value[at : spots[a][0]])
        at = spots[b - 1][1]
    return b"".join([*kept, value[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", max_coverage: float = 0.5, window: int = 10) -> DataFrame:
    """``docs`` without what they share with the items.

    A run of hit words, whole windows or all the words of a shorter item, goes from the text; a document goes if
    its hit words are more than ``max_coverage`` of its words. Others stay as they are.
    """
    kept = docs.columns

    def finish(batch: pa.RecordBatch, values: list[bytes], n_words: list[int], starts: list[list[int]], ends: list[list[int]]) -> pa.RecordBatch:
        texts, keep = batch.column(text).to_pylist(), []
        for i, (n, a, b) in enumerate(zip(n_words, starts, ends, strict=True)):
            hit = sum(b) - sum(a)
            keep.append(not hit or hit <= max_coverage * n)
            if hit and keep[-1]:
                texts[i] = cut_words(values[i], list(zip(a, b, strict=True))).decode()
        columns = [pa.array(texts, batch.column(c).type) if c == text else batch.column(c) for c in kept]
        return pa.RecordBatch.from_arrays(columns, names=kept).filter(pa.array(keep, pa.bool_()))

    return match_items(docs, items, text=text, window=window, finish=finish)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what match_items found."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> dict[int, tuple]:
    """The same by comparing every window with every place; for tests."""
    split = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    wins = []
    for item, t in items:
        w = split(t)
        wins += [(tuple(w[i : i + window]), item) for i in range(max(1, len(w) - window + 1))] if w else []
    out = {}
    for doc, t in docs:
        w = split(t)
        hit, who = set(), set()
        for win, item in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    who.add(str(item))
        out[doc] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out
