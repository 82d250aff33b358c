"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import hash_share, text_of

#: The contract's rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://."""
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, in lower case; null and other texts have none."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, and the longest rule that fits, with its verdict (null where none does)."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return out.withColumn("rule", rule).withColumn("verdict", verdict)


# Features.

MEASURES = ("length", "host_length", "labels", "longest_label", "hyphens", "depth", "path_length", "digits", "host_digits", "entropy", "host_entropy", "parameters", "longest_value", "fragment", "secure", "suffix_rate", "site_rate")
SUFFIX_SLOTS = 4096


def entropy(text: str) -> float:
    n = len(text)
    return -sum((k := text.count(c)) / n * math.log2(k / n) for c in set(text)) if n else 0.0


def parts(url: str) -> tuple[str, str, str, str]:
    """Host, path, query and fragment, as host_of and path_of split it."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", "", "", ""
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path, query, fragment


def suffix_slots(host: str) -> tuple[int, int]:
    """Slots of the host's last label and of its last two, in tables of fixed size."""
    labels = host.rsplit(".", 2)
    return zlib.crc32(labels[-1].encode()) % SUFFIX_SLOTS, zlib.crc32(".".join(labels[-2:]).encode()) % SUFFIX_SLOTS


def measures(url: str) -> list[float]:
    host, path, query, fragment = parts(url)
    labels = host.split(".")
    names = query.split("&") if query else []
    return [
        len(url), len(host), len(labels), max(map(len, labels)), host.count("-"), path.count("/"), len(path), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), entropy(url), entropy(host),
        len(names), max((len(x.partition("=")[2]) for x in names), default=0), len(fragment), float(url.startswith("https")),
    ]


class UrlModel:
    """Boosted trees over binned features. The rates of blocked URLs by suffix are smoothed counts over the labelled URLs."""

    def __init__(self, rounds: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2, penalty: float = 1.0):
        self.rounds, self.depth, self.bins, self.rate, self.penalty = rounds, depth, bins, rate, penalty
        self.base, self.trees = 0.0, []
        self.counts = np.zeros((2, SUFFIX_SLOTS, 2))

    def table(self, urls: list[str], labels: np.ndarray | None = None) -> np.ndarray:
        """Features of URLs; with labels, each URL's own label is taken out of its rates."""
        if not urls:
            return np.zeros((0, len(MEASURES)))
        slots = np.array([suffix_slots(parts(u)[0]) for u in urls])
        own = np.zeros((len(urls), 2)) if labels is None else np.eye(2)[labels]
        rates = []
        for k in range(2):
            seen = self.counts[k][slots[:, k]] - own
            rates.append((seen[:, 1] + 1) / (seen.sum(1) + 2))
        return np.column_stack([np.array([measures(u) for u in urls], float), *rates])

    def fit(self, urls: list[str], labels: list[int]) -> UrlModel:
        y = np.array(labels, int)
        if not len(y):
            return self
        for k in range(2):
            np.add.at(self.counts[k], (np.array([suffix_slots(parts(u)[0])[k] for u in urls]), y), 1)
        x = self.table(urls, y)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 0.01, 0.99)
        self.base = math.log(p / (1 - p))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            tree = self._tree(b, prob - y, prob * (1 - prob))
            self.trees.append(tree)
            score += self.rate * self._apply(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)])

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node and the value of each leaf, as a full binary tree; each level takes the best gain at each node."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, self.bins)
        node = np.zeros(len(g), int)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            local = node - first
            for f in range(b.shape[1]):
                key = local * self.bins + b[:, f]
                gs, hs = (np.bincount(key, w, n * self.bins).reshape(n, self.bins).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better], feature[first : first + n][better], cut[first : first + n][better] = top[better], f, k[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = (np.bincount(leaf, w, 2**self.depth) for w in (g, h))
        return feature, cut, -gs / (hs + self.penalty)

    def _apply(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), int)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    def scores(self, urls: list[str]) -> np.ndarray:
        """The probability that a URL is to be blocked."""
        score = np.full(len(urls), self.base)
        if self.trees and urls:
            b = self._binned(self.table(urls))
            for tree in self.trees:
                score += self.rate * self._apply(tree, b)
        return 1 / (1 + np.exp(-score))


def made_urls(n: int, seed: int = 4) -> list[tuple[str, int]]:
    """Labelled URLs made by rule: plain ones (0), and ones with the marks of spam and of machine-made addresses (1)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices(("an", "be", "cor", "da", "el", "fin", "ha", "th", "on", "er", "ti", "re"), k=r.randint(1, 3)))
    noise = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    top = lambda: r.choice(("com", "net", "org", "info"))
    out = []
    for k in range(n):
        if k % 2:
            host = r.choice([f"{word()}-{word()}-{r.randint(1, 999)}", noise(18), f"cheap-{word()}", f"spam-{word()}", f"{noise(6)}.{noise(9)}.{word()}", f"{word()}-{word()}.{word()}"])
            path = "/".join(noise(r.randint(6, 24)) for _ in range(r.randint(1, 6)))
            query = "?" + "&".join(f"{noise(3)}={noise(r.randint(4, 30))}" for _ in range(r.randint(1, 6))) if r.random() < 0.7 else ""
        else:
            host = r.choice(["", "", "www.", "blog.", "m."]) + word()
            path = "/".join(r.choice([word(), word(), str(r.randint(1, 999)), "en", f"{word()}-{word()}"]) for _ in range(r.randint(1, 3))) + r.choice(["", "/", ".html"])
            query = r.choice(["", "", "?page=2", "#top", f"?ref={word()}"])
        out.append((f"http{'s' * (r.random() < 0.5)}://{host}.{word()}.{top()}/{path}{query}", k % 2))
    return out


def train(labelled: DataFrame, *, sample: int = 20_000, made: int = 2_000, longest: int = 4096) -> UrlModel:
    """A model from ``labelled`` (url, label: 1 to block) and ``made`` URLs made by rule.

    Of ``labelled``, the ``sample`` distinct rows with the smallest hashes are used: a bound on what the driver sees, the same
    rows at each run. Hashes that are too large for that, by the number of URLs, go before any row is sent anywhere. URLs of over
    ``longest`` code points are not learned from.
    """
    labelled = labelled.select("url", "label").where((F.length("url") <= longest) & F.col("label").isNotNull())
    spread = F.pmod(F.xxhash64("url"), F.lit(1 << 32))
    n = labelled.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    share = hash_share(sample, 0.9 * n)
    rows = labelled.where(spread < share).distinct().orderBy(spread, "url", "label").limit(sample).collect()
    more = made_urls(made)
    return UrlModel().fit([r.url for r in rows] + [u for u, _ in more], [int(r.label) for r in rows] + [y for _, y in more])


def judge(pages: DataFrame, *, url: str = "url", rules=RULES, labelled: DataFrame | None = None, sample: int = 20_000) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and the model's score for every URL.

    A rule's verdict stands; else a score of 0.5 or more blocks. Null URLs and those without :// have an empty host and path, fit
    no rule and are scored as they stand. Each row is judged by its own URL, so repeated rows get equal verdicts; of rules of one
    length the first by name counts. An empty table gives an empty table. ``labelled`` defaults to the URLs that rules decide. Scores are computed row by row;
    the model has a fixed size. Columns by the names of the result are replaced.
    """
    ruled = with_rules(pages.drop("host", "path", "rule", "verdict", "score"), url, rules)
    if labelled is None:
        labelled = ruled.where("rule is not null").select(F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("label"))
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled, sample=sample))
    kept = ruled.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(text_of(batch.column(url)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*kept, "score"])

    fields = "".join(f"`{c}` {ruled.schema[c].dataType.simpleString()}, " for c in kept)
    scored = ruled.mapInArrow(run, f"{fields}score double")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
