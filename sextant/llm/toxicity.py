"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, on overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import hash_share, pieces, utf8, words

WINDOW, STRIDE = 48, 32
SLOTS, EMBEDDED, WIDTH = 1 << 18, 1 << 12, 4
GRAMS = (3, 4, 5, 6)
#: Inputs of a word: evidence of the word, mean and largest evidence of its character runs, and two embeddings.
INPUTS = 3 + 2 * WIDTH
HIDDEN, ATTENTION = 8, 8
_POWERS = np.random.default_rng(1).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Vocabulary:
    """Distinct words as one buffer, with the slots of each word and of its character runs (of 3 to 6 bytes, a space at either end)."""

    def __init__(self, distinct: pa.Array, part: int = 1 << 15):
        self.n = len(distinct)
        made = [self._part(distinct.slice(a, part)) for a in range(0, self.n, part)]
        self.word, self.slots, self.counts = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int32) for k in range(3))
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts  # each word has a run at least: a letter between spaces

    @staticmethod
    def _part(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b" ".join([b"", *distinct.to_pylist(), b""])
        buffer = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        spaces = np.flatnonzero(buffer == 33)
        starts, lengths = spaces[:-1], np.diff(spaces)  # the space before each word and the word
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.arange(len(word)) - starts[word]
        h = np.add.reduceat(buffer[: len(word)] * _POWERS[place % 64] + place.astype(np.uint64), starts)
        slots, owner = [], []
        room = (lengths + 1)[word] - place  # bytes from here to the space after the word
        rolled = np.zeros(len(word), np.uint64)
        for k in range(max(GRAMS)):
            shifted = buffer[k : k + len(word)]
            rolled[: len(shifted)] += shifted * _POWERS[k]
            if k + 1 in GRAMS:
                ok = np.flatnonzero(room >= k + 1)
                slots.append((_mixed(rolled[ok] + np.uint64(k)) % np.uint64(SLOTS)).astype(np.int32))
                owner.append(word[ok])
        slots, owner = np.concatenate(slots), np.concatenate(owner)
        return (_mixed(h) % np.uint64(SLOTS)).astype(np.int32), slots[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths)).astype(np.int32)

    def runs(self, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the runs of some words, and which of these words each is from."""
        n = self.counts[words_]
        owner = np.repeat(np.arange(len(words_)), n)
        return self.slots[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.starts[words_][owner]], owner


class Evidence:
    """In how many toxic and other training texts each slot occurs; the smoothed log odds against the base rate."""

    def __init__(self, strength: float = 4.0):
        self.counts = np.zeros((2, 2, SLOTS), np.float32)  # word or run, label, slot
        self.totals, self.rate, self.strength = np.ones(2, np.float32), 0.3, strength

    def odds(self, kind: int, slots: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """own: the labels of the texts the slots are from, to leave each text out of its own evidence."""
        other, toxic = self.counts[kind][0][slots], self.counts[kind][1][slots]
        n = self.totals
        if own is not None:
            other, toxic = other - (own == 0), toxic - (own == 1)
        a, p = self.strength, self.rate
        return np.clip(np.log((toxic + a * p) / (other * n[1] / n[0] * (1 - p) / p + a * (1 - p))) - np.log(p / (1 - p)), -3, 5).astype(np.float32) / 2

    def learn(self, kind: int, slots: np.ndarray, label: int) -> None:
        """slots: of one text, each once."""
        self.counts[kind][label][slots] += 1

    def begin(self, labels: np.ndarray) -> None:
        self.totals = np.maximum(1, np.bincount(labels, minlength=2)).astype(np.float32)


class Network:
    """Parameters: embeddings, the two recurrent layers, attention, output."""

    def __init__(self, seed: int = 2):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.p = {"ew": f(EMBEDDED, WIDTH, scale=0.05), "ec": f(EMBEDDED, WIDTH, scale=0.05)}
        for d in "fb":
            self.p |= {f"x{d}": f(INPUTS, 3 * HIDDEN, scale=INPUTS**-0.5), f"u{d}": f(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": f(2 * HIDDEN, ATTENTION, scale=0.25), "ab": np.zeros(ATTENTION, np.float32), "v": f(ATTENTION, scale=0.5), "o": f(2 * HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32)}
        self.evidence = Evidence()
        self.shift = 0.0

    def inputs(self, v: Vocabulary, own_word: np.ndarray | None = None) -> np.ndarray:
        """A row for each word; own_word: the label of the text each word is from, in training."""
        x = np.empty((v.n, INPUTS), np.float32)
        for a in range(0, v.n, 1 << 14):
            some = slice(a, a + (1 << 14))
            n = v.counts[some]
            slots, starts = v.slots[v.starts[a] : v.starts[a] + n.sum()], np.cumsum(n) - n
            own = None if own_word is None else own_word[some]
            x[some, 0] = self.evidence.odds(0, v.word[some], own)
            found = self.evidence.odds(1, slots, None if own is None else np.repeat(own, n))
            x[some, 1] = np.add.reduceat(found, starts) / n
            x[some, 2] = np.maximum.reduceat(found, starts)
            x[some, 3 : 3 + WIDTH] = self.p["ew"][v.word[some] % EMBEDDED]
            x[some, 3 + WIDTH :] = np.add.reduceat(self.p["ec"][slots % EMBEDDED], starts) / n[:, None]
        return x

    def _layer(self, pre: np.ndarray, index: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, t = index.shape
        out = np.empty((t, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        u = self.p[f"u{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            x, hu = pre[index[:, k]], h @ u
            g = np.tanh((x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]) * 0.5) * 0.5 + 0.5
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[:, k, None]
            if keep is not None:
                keep.append((k, h, hu[:, 2 * HIDDEN :], z, r, new, m))
            h = h + m * (1 - z) * (new - h)
            out[k] = h
        return out

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}

    def logits(self, pre: dict[str, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of windows: index has each window's words as rows of the projected inputs, mask where there is a word."""
        kept: dict[str, list | None] = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        s = np.concatenate([self._layer(pre[d], index, mask, d, kept[d]) for d in "fb"], 2)  # time, window, state
        q = np.tanh(s @ self.p["a"] + self.p["ab"])
        e = q @ self.p["v"] + np.where(mask.T > 0, 0, -30).astype(np.float32)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = (e[:, :, None] * s).sum(0)
        if keep is not None:
            keep |= {"kept": kept, "s": s, "q": q, "e": e, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["ob"]

    def gradient(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted logistic loss by each parameter but the embeddings, and by x."""
        k: dict = {}
        dz = (1 / (1 + np.exp(-self.logits(self.projected(x), index, mask, k))) - y) * weight / weight.sum()
        s, q, e = k["s"], k["q"], k["e"]
        g = {"o": k["pooled"].T @ dz, "ob": dz.sum(keepdims=True)}
        dpool = dz[:, None] * self.p["o"]
        de = (s * dpool).sum(2)
        de = e * (de - (e * de).sum(0))
        dq = de[:, :, None] * self.p["v"] * (1 - q * q)
        g |= {"v": np.einsum("tn,tnk->k", de, q), "a": np.einsum("tni,tnk->ik", s, dq), "ab": dq.sum((0, 1))}
        ds = e[:, :, None] * dpool + dq @ self.p["a"].T
        dx = np.zeros_like(x)
        flat = index.T.ravel()
        for half, d in enumerate("fb"):
            u, own = self.p[f"u{d}"], ds[:, :, half * HIDDEN : (half + 1) * HIDDEN]
            dpre, gu = np.zeros((*index.T.shape, 3 * HIDDEN), np.float32), np.zeros_like(u)
            dh = np.zeros_like(own[0])
            for t, h, hn, z, r, new, m in reversed(k["kept"][d]):
                dh = dh + own[t]
                dm = dh * m
                dn = dm * (1 - z) * (1 - new * new)
                dg = np.concatenate([dm * (h - new) * z * (1 - z), dn * hn * r * (1 - r), dn * r], 1)
                dpre[t] = np.concatenate([dg[:, : 2 * HIDDEN], dn], 1)
                gu += h.T @ dg
                dh = dh - dm * (1 - z) + dg @ u.T
            dpre = dpre.reshape(-1, 3 * HIDDEN)
            g |= {f"x{d}": x[flat].T @ dpre, f"u{d}": gu, f"b{d}": dpre.sum(0)}
            np.add.at(dx, flat, dpre @ self.p[f"x{d}"].T)
        return g, dx

    def fit(self, texts: list[bytes], labels: list[int], rate_of_toxic: float, rounds: int = 10, size: int = 192, seed: int = 6) -> Network:
        """Each text is a bag of windows that is as toxic as its most toxic one, which alone is learned from, again and again (Adam)."""
        y = np.array(labels, np.int64)
        split = [words(t) for t in texts]
        coded = [pa.array(w, pa.binary()).dictionary_encode() for w in split]
        del split
        if not len(y) or y.min() == y.max():
            self.p["o"][:] = 0
            self.p["ob"][:] = -4  # one class only: nothing tells toxic texts apart, so none is called toxic
            self.evidence.begin(y)
            return self
        v = Vocabulary(pa.concat_arrays([c.dictionary for c in coded]))
        sizes = np.array([len(c.dictionary) for c in coded])
        base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        own = np.repeat(y.astype(np.int8), sizes)
        self.evidence.begin(y)
        for t, (a, n) in enumerate(zip(base.tolist(), sizes.tolist(), strict=True)):  # a slot counts once in a text
            if n:
                self.evidence.learn(0, np.unique(v.word[a : a + n]), y[t])
                self.evidence.learn(1, np.unique(v.slots[v.starts[a] : v.starts[a + n - 1] + v.counts[a + n - 1]]), y[t])
        index, mask, bag = windows([c.indices.to_numpy() + b for c, b in zip(coded, base, strict=True)])
        first = np.searchsorted(bag, np.arange(len(y)))
        weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())).astype(np.float32)
        r = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in self.p.items()}
        step = 0
        for turn in range(rounds):
            x = self.inputs(v, own)
            z = x[index, 0].max(1) + x[index, 2].max(1) if turn == 0 else self._all(x, index, mask)
            order = np.lexsort((-z, bag))
            top = order[first]
            for batch in np.array_split(r.permutation(len(y)), max(1, len(y) // size)):
                chosen = top[batch]
                used, at = np.unique(index[chosen], return_inverse=True)
                g, dx = self.gradient(x[used], at.reshape(len(chosen), -1), mask[chosen], y[batch].astype(np.float32), weight[batch])
                ew, ec = np.zeros_like(self.p["ew"]), np.zeros_like(self.p["ec"])
                np.add.at(ew, v.word[used] % EMBEDDED, dx[:, 3 : 3 + WIDTH])
                slots, owner = v.runs(used)
                np.add.at(ec, slots % EMBEDDED, (dx[:, 3 + WIDTH :] / v.counts[used][:, None])[owner])
                g |= {"ew": ew, "ec": ec}
                step += 1
                for k, d in g.items():
                    d = d + (1e-3 if k in ("ew", "ec") else 1e-4) * self.p[k]
                    m1, m2 = moments[k]
                    m1 += 0.1 * (d - m1)
                    m2 += 0.01 * (d * d - m2)
                    self.p[k] -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        self.shift = float(np.log(rate_of_toxic / (1 - rate_of_toxic))) / 2  # learned at even weights; half way to the true rate
        return self

    def _all(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, size: int = 2048) -> np.ndarray:
        """The logits of all windows; inputs are projected part by part where there are many of them."""
        out, pre = [], self.projected(x) if len(x) < 1 << 17 else None
        for a in range(0, len(index), size):
            part, m = index[a : a + size], mask[a : a + size]
            if pre is None:
                used, at = np.unique(part, return_inverse=True)
                out.append(self.logits(self.projected(x[used]), at.reshape(part.shape), m))
            else:
                out.append(self.logits(pre, part, m))
        return np.concatenate(out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The largest probability among each text's windows; a text without words is one empty window."""
        split = [words(t) for t in texts]
        coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
        v = Vocabulary(coded.dictionary) if len(coded) else None
        x = self.inputs(v) if v else np.zeros((1, INPUTS), np.float32)
        ends = np.cumsum([len(s) for s in split])
        index, mask, bag = windows(np.split(coded.indices.to_numpy(), ends[:-1]) if v else [np.zeros(0, np.int32)] * len(texts))
        z = self._all(x, index, mask) + self.shift
        return 1 / (1 + np.exp(-np.maximum.reduceat(z, np.searchsorted(bag, np.arange(len(texts)))).astype(float)))


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of WINDOW words at steps of STRIDE, one at least for each text: word numbers, mask, and the text of each."""
    sizes = np.array([len(t) for t in texts])
    n = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    bag = np.repeat(np.arange(len(texts)), n)
    start = (np.arange(len(bag)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = start[:, None] + np.arange(WINDOW)
    mask = place < sizes[bag][:, None]
    flat = np.concatenate([*texts, np.zeros(1, np.int64)]).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    return np.where(mask, flat[np.where(mask, base[bag][:, None] + place, 0)], 0), mask.astype(np.float32), bag


def training_rows(docs: DataFrame, labels: DataFrame, *, toxic: int, other: int, longest: int = 1 << 18) -> tuple[list[bytes], list[int], float]:
    """Texts and labels of at most ``toxic`` and ``other`` labelled documents, those with the smallest hashes, and the rate among all.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Contradicting labels of a document count as toxic; rows without an
    id or a label are left out. Texts of more than ``longest`` bytes are not learned from, so the driver sees a bounded number of
    bytes; those of repeated rows of an id count once for each different text. No labels give no rows.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    first = lambda y, n: known.where((F.col("toxic") == y) & (spread < hash_share(n, counts.get(y, 0)))).orderBy(spread, "doc_id").limit(n)
    chosen = {r.doc_id: r.toxic for r in first(1, toxic).union(first(0, other)).collect()}
    if not chosen:
        return [], [], 0.1
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted(chosen)], "doc_id long")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(ids), "doc_id", "left_semi").distinct().collect()  # ids: toxic + other rows at most
    rows.sort(key=lambda r: (r.doc_id, r.text or b""))
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return [bytes(r.text or b"") for r in rows], [chosen[r.doc_id] for r in rows], min(0.5, max(0.01, rate))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Network, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``: the model's probability, 0 to 1, that the text is toxic.

    Null and empty texts are scored as one window without words, rows without an id like others; repeated rows get equal scores and
    an empty table gives an empty one. Each text is scored by itself, whole; nothing is shuffled, and
    memory is bounded by 2 MB of text or one longer text. A column by the name of the result is replaced.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(utf8(batch.column(text))), pa.float64())], names=[*kept, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}score double")


def trained(docs: DataFrame, labels: DataFrame, *, toxic: int = 500, other: int = 1000) -> Network:
    """A network from a bounded sample of the labelled documents: ``toxic`` and ``other`` are the bounds."""
    texts, y, rate = training_rows(docs, labels, toxic=toxic, other=other)
    return Network().fit(texts, y, rate)
