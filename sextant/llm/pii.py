"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss."""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import pieces, text_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Fixed patterns of the contract. Possessive where a run can only be taken whole, so that no text takes quadratic time.
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, leftmost and without overlap for each kind, by kind and start."""
    found: list[Span] = []
    end = 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            end = m.end()
    if not DIGIT.search(text):
        return found
    # A digit run is taken whole by a match that ends in it, so a later match can only start at a later run.
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= len(m[0]) and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


# The model's view of a text: tokens around triggers, and candidate segments of them.

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
TRIGGER = re.compile(r"[0-9]{2,}|@|[\[({] ?(?:at|AT) ?[\])}]|\b(?:at|AT)\b(?=[^\n]{1,48}\b(?:dot|DOT)\b)")
#: The marks that an entity may have inside.
MARKS = frozenset(" .-_+()[]{}<>@: ")
#: Tokens that an entity has at most, and tokens around a trigger that are looked at.
LONGEST, AROUND = 24, 12
AT, DOT = frozenset(("at", "@")), frozenset(("dot", "."))
FEATURES = 1 << 12


def islands(text: str) -> Iterator[list[tuple[str, int]]]:
    """Stretches of tokens, with their places, about AROUND tokens to either side of what any entity must contain."""
    at, spots = 0, TRIGGER.finditer(text)
    m = next(spots, None)
    reach = 6 * AROUND
    while m:
        start, end = max(at, m.start() - reach), m.end() + reach
        while (m := next(spots, None)) and m.start() - reach <= end:
            end = m.end() + reach
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        yield [(x[0], x.start()) for x in TOKEN.finditer(text, start, end)]


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """The segments that could be an entity: on one line, with whole words at the ends, and seven digits, four numbers or an at sign in them."""
    n = len(tokens)
    word = [t[0].isalnum() for t in tokens]
    number = [t[0].isdigit() and t.isascii() for t in tokens]
    has_at = [t.lower() in AT for t in tokens]
    out = []
    for i in range(n):
        if not (word[i] or tokens[i] in "+(") or i and word[i] and word[i - 1]:
            continue
        digits = numbers = letters = ats = dots = 0
        for j in range(i, min(n, i + LONGEST)):
            t = tokens[j]
            if not word[j] and t not in MARKS:
                break
            if number[j]:
                digits += len(t)
                numbers += 1
            elif word[j]:
                letters += 1
            ats += has_at[j]
            dots += t.lower() in DOT
            if ats > 1 or not ats and letters > 3 or digits > 24:
                break
            if word[j] and not (j + 1 < n and word[j + 1]) and (ats and dots and j > i + 2 or not letters and (7 <= digits <= 19 or numbers == 4 and dots >= 3)):
                out.append((i, j + 1))
    return out


@lru_cache(maxsize=1 << 14)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def span_features(tokens: list[str], i: int, j: int) -> list[int]:
    """Numbers of the features of a whole segment and its surroundings."""
    own = tokens[i:j]
    text = "".join(own)
    d = digits_of(text)
    shape = "".join("9" * min(len(t), 5) if t.isdigit() else "a" if t[0].isalpha() else t for t in own)
    numbers = [t for t in own if t.isdigit()]
    marks = "".join(sorted({t for t in own if not t[0].isalnum()}))
    low = [t.lower() for t in own]
    left = [t.lower() for t in tokens[max(0, i - 4) : i] if not t.isspace()]
    right = [t.lower() for t in tokens[j : j + 2] if not t.isspace()]
    at = next((k for k, t in enumerate(low) if t in AT), -1)
    names = [
        "bias", f"digits{len(d)}", f"groups{len(numbers)}", f"shape{shape}" if at < 0 else f"at{low[at]}", f"marks{marks}", f"first{own[0] if not own[0].isalnum() else own[0].isdigit()}",
        f"luhn{len(d) >= 13 and luhn(d)}{len(d)}", f"bytes{len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)}{marks}", f"left{left[-1] if left else '^'}", f"left2{left[-2] if len(left) > 1 else '^'}",
        f"right{right[0] if right and not right[0].isalnum() else 'w'}", f"sizes{'-'.join(str(len(x)) for x in numbers[:6])}" if at < 0 else "mail",
    ]
    if at >= 0:
        after, before = low[at + 1 :], low[:at]
        names += [f"wrapped{before[-1:] + after[:1]}", f"top{len(after[-1]) if after else 0}", f"dots{sum(t in DOT for t in after)}", f"spelled{'dot' in after}", f"local{sum(t[0].isalnum() for t in before)}", f"gap{sum(t.isspace() for t in own)}", f"only{all(t[0].isalnum() or t in '._-+()[]{}<>@ ' for t in low)}"]
    return [_slot(x) for x in names]


class SemiMarkovCRF:
    """Segments of a token sequence with labels 0 (outside, one token) and 1.. (KINDS, up to LONGEST tokens).

    A segmentation's score is the sum over its segments of the weights of the segment's features for its label and of the
    transition from the label before; the likelihood and its gradient come from sums over all segmentations.
    """

    def __init__(self):
        n = len(KINDS) + 1
        self.weights = np.zeros((FEATURES, n))
        self.moves = np.zeros((n, n))

    def _scores(self, tokens: list[str]) -> tuple[list[tuple[int, int]], list[list[int]], np.ndarray]:
        spans = candidates(tokens)
        numbers = [span_features(tokens, i, j) for i, j in spans]
        return spans, numbers, np.array([self.weights[f].sum(0) for f in numbers]) if spans else np.zeros((0, len(KINDS) + 1))

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: start, end, label."""
        spans, _, scores = self._scores(tokens)
        if not spans:
            return []
        return self._best(len(tokens), spans, scores)

    def _best(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        labels = len(KINDS) + 1
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(spans):
            ending.setdefault(j, []).append(k)
        best = np.full((n + 1, labels), -np.inf)
        best[0, 0] = 0
        into, before = np.empty((n + 1, labels)), np.empty((n + 1, labels), int)
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(n + 1):
            if j:
                best[j, 0] = into[j - 1, 0]
                for k in ending.get(j, ()):
                    i = spans[k][0]
                    for y in range(1, labels):
                        if (s := into[i, y] + scores[k, y]) > best[j, y]:
                            best[j, y] = s
                            back[j, y] = (i, y)
            both = best[j][:, None] + self.moves
            into[j], before[j] = both.max(0), both.argmax(0)
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i = back[j, y][0] if y else j - 1
            if y:
                out.append((i, j, y))
            j, y = i, int(before[i, y])
        return out[::-1]

    def fit(self, examples: list[tuple[list[str], list[tuple[int, int, int]]]], rounds: int = 6, rate: float = 0.4, decay: float = 1e-4) -> SemiMarkovCRF:
        """Stochastic ascent of the log-likelihood with per-weight steps (AdaGrad); the order of examples is fixed."""
        grown_w, grown_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        seen = []
        for tokens, gold in examples:
            spans = candidates(tokens)
            numbers = np.array([np.pad(f, (0, 20 - len(f)), constant_values=-1) for f in (span_features(tokens, i, j) for i, j in spans)]).reshape(-1, 20)
            seen.append((len(tokens), spans, numbers, {(a, b): y for a, b, y in gold}))
        order = list(range(len(seen)))
        shuffle = random.Random(7)
        self.weights = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]))])  # row -1: no feature
        for _ in range(rounds):
            shuffle.shuffle(order)
            for e in order:
                n, spans, numbers, gold = seen[e]
                if not spans:
                    continue
                expect, moves = self._expected(n, spans, self.weights[numbers].sum(1))
                step = -expect
                label = np.zeros(n + 1, int)
                for k, s in enumerate(spans):
                    if s in gold:
                        step[k, gold[s]] += 1
                at, last = 0, 0
                starts = {a: (b, y) for (a, b), y in gold.items()}
                while at < n:
                    b, y = starts.get(at, (at + 1, 0))
                    moves[last, y] -= 1
                    at, last = b, y
                used = np.unique(numbers[numbers >= 0])
                change = np.zeros((FEATURES + 1, step.shape[1]))
                np.add.at(change, numbers.ravel(), np.repeat(step, numbers.shape[1], 0))
                g = change[used] - decay * self.weights[used]
                grown_w[used] += g * g
                self.weights[used] += rate * g / np.sqrt(grown_w[used])
                grown_m += moves * moves
                self.moves -= rate * moves / np.sqrt(grown_m)
                self.weights[-1] = 0
        self.weights = self.weights[:-1]
        return self

    def _expected(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of each segment by label, and of the moves, over all segmentations."""
        labels = scores.shape[1]
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(spans):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        low = -1e30
        ahead, into = np.full((n + 1, labels), low), np.full((n + 1, labels), low)
        ahead[0, 0] = 0
        for j in range(n + 1):
            if j:
                ahead[j, 0] = into[j - 1, 0]
                if ks := ending.get(j):
                    ahead[j, 1:] = np.logaddexp.reduce(np.array([into[spans[k][0], 1:] + scores[k, 1:] for k in ks]), axis=0)
            into[j] = np.logaddexp.reduce(ahead[j][:, None] + self.moves, axis=0)
        total = np.logaddexp.reduce(ahead[n])
        behind, out = np.full((n + 1, labels), low), np.full((n + 1, labels), low)  # behind: after a label ended; out: when one is about to start
        behind[n] = 0
        for i in range(n - 1, -1, -1):
            out[i, 0] = behind[i + 1, 0]
            if ks := starting.get(i):
                out[i, 1:] = np.logaddexp.reduce(np.array([behind[spans[k][1], 1:] + scores[k, 1:] for k in ks]), axis=0)
            behind[i] = np.logaddexp.reduce(out[i][None, :] + self.moves, axis=1)
        expect = np.zeros_like(scores)
        for k, (i, j) in enumerate(spans):
            expect[k, 1:] = np.exp(np.minimum(0, into[i, 1:] + scores[k, 1:] + behind[j, 1:] - total))
        moves = np.exp(np.minimum(0, ahead[:-1, :, None] + self.moves + out[:-1, None, :] - total)).sum(0)
        return expect, moves


# Training texts: made by rule, from a seed.

SYLLABLES = "an be cor da el fin go hal is jo ka lem mi nor os pa qui ra sol ta un ver wa yes zon".split()
TOPS = "com net org io de fr es info".split()


def _word(r: random.Random) -> str:
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 3)))


def _card(r: random.Random, n: int, good: bool = True) -> str:
    head = r.choice("3456") + "".join(r.choices("0123456789", k=n - 2))
    return head + next(c for c in "0123456789" if luhn(head + c) == good)


def _entity(r: random.Random) -> tuple[str, str]:
    number = lambda *sizes: ["".join(r.choices("0123456789", k=k)) for k in sizes]
    kind = r.choice(KINDS)
    if kind == "email":
        name = r.choice(["{a}", "{a}.{b}", "{a}{n}", "{a}_{b}", "{a}.{n}"]).format(a=_word(r), b=_word(r), n=r.randint(1, 99))
        at, dot = r.choice([("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" [at] ", "."), (" @ ", " . "), (" at ", " dot "), ("(at)", "."), (" AT ", " DOT "), ("{at}", "{dot}")])
        return kind, name + at + dot.join([_word(r), *([_word(r)] if r.random() < 0.3 else []), r.choice(TOPS)])
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return kind, r.choice([".", ".", " . ", "[.]", "(.)"]).join(parts)
    if kind == "card":
        d = _card(r, r.choice([16, 16, 15, 16]))
        return kind, d if r.random() < 0.3 else r.choice([" ", "-", ".", "  "]).join([d[:4], d[4:8], d[8:12], d[12:]] if len(d) == 16 else [d[:4], d[4:10], d[10:]])
    a, b, c = number(3, 3, 4)
    return kind, r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"00{' '.join(number(2, 2, 7))}", f"{a} {b} {c}", f"+{' '.join(number(2, 3, 3, 3))}", f"1-{a}-{b}-{c}"])


def _other(r: random.Random) -> str:
    number = lambda k: "".join(r.choices("0123456789", k=k))
    return r.choice([
        f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(0, 23)}:{number(2)}:{number(2)}", f"v{r.randint(1, 9)}.{r.randint(1, 20)}.{r.randint(0, 9)}", f"{number(3)},{number(3)},{number(3)}.{number(2)}",
        f"order {number(r.choice([8, 9, 12, 14]))}", f"id {_card(r, 16, False)}", f"{_word(r)} at {_word(r)}. {_word(r)}", "".join(r.choices("0123456789abcdef", k=32)), f"pages {number(3)}-{number(3)}", f"{number(4)} {number(4)}",
        f"ISBN 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"at {_word(r)}.{_word(r)} {number(2)}", f"{number(2)}.{number(2)}.{r.randint(1900, 2099)} {number(2)}:{number(2)}", f"{number(20)}", f"meet @ {_word(r)}, {number(2)}. {_word(r)}",
    ])


def _label_words(r: random.Random, kind: str) -> str:
    cues = {"email": ["mail", "write to", "contact", ""], "ip": ["host", "address", "server", ""], "card": ["card", "visa", "pay with", ""], "phone": ["call", "tel", "phone", "fax", ""]}
    return r.choice(cues[kind])


def make_examples(n: int, seed: int) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """``n`` token sequences with their entities as start, end and label."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 2)):
            text += " ".join(_word(r) for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.6:
                kind, entity = _entity(r)
                cue = _label_words(r, kind)
                text += cue + (r.choice([" ", ": "]) if cue else "")
                gold.append((len(text), len(text) + len(entity), KINDS.index(kind) + 1))
                text += entity
            else:
                text += _other(r)
            text += r.choice([" ", ". ", ", ", "\n"])
        text += " ".join(_word(r) for _ in range(2))
        spots = [m.span() for m in TOKEN.finditer(text)]
        first, last = {a: k for k, (a, _) in enumerate(spots)}, {b: k + 1 for k, (_, b) in enumerate(spots)}
        tokens = [text[a:b] for a, b in spots]
        spans = set(candidates(tokens))
        gold = [(first[a], last[b], y) for a, b, y in gold if a in first and b in last]
        out.append((tokens, [g for g in gold if g[:2] in spans]))
    return out


@lru_cache(maxsize=1)
def trained(examples: int = 500, seed: int = 11) -> SemiMarkovCRF:
    return SemiMarkovCRF().fit(make_examples(examples, seed))


def added_spans(text: str, model: SemiMarkovCRF, taken: list[Span]) -> list[Span]:
    """The model's entities that touch none of the spans already taken."""
    out: list[Span] = []
    starts: list[int] = []  # of what is taken, as stretches apart from each other
    ends: list[int] = []
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    for island in islands(text):
        tokens = [t for t, _ in island]
        for i, j, y in model.decode(tokens):
            a, b = island[i][1], island[j - 1][1] + len(tokens[j - 1])
            k = bisect_right(ends, a)  # the first stretch that ends after a
            if k == len(ends) or starts[k] >= b:
                out.append((KINDS[y - 1], a, b))
    return out


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, *, text: str = "text", model: SemiMarkovCRF | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` for ``text``: arrays of (kind, start, end) in code points, end exclusive.

    ``base`` are the fixed patterns' matches; ``spans`` those and what the model adds where no base span is touched. Null and
    empty texts have none. Rows are looked at one by one, whole, so repeated rows get equal spans and an empty table an empty one;
    nothing is shuffled. The model is trained on a fixed number of
    made texts, on the driver, and has a fixed size. Columns by the names of the result are replaced.
    """
    docs = docs.drop("base", "spans")
    kept = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        as_rows = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
        for batch in pieces(batches, text):
            base, spans = [], []
            for value in text_of(batch.column(text)):
                own = base_spans(value)
                base.append(as_rows(own))
                spans.append(as_rows(sorted(own + added_spans(value, crf, own), key=lambda s: (KINDS.index(s[0]), s[1]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(base, kind), pa.array(spans, kind)], names=[*kept, "base", "spans"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.mapInArrow(run, f"{fields}base {spans}, spans {spans}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
