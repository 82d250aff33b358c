"""HTML extraction: leaf blocks of a page, labelled by a bidirectional LSTM over their tag paths and words."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sextant.llm.common import pieces, text_of

# Fixed sets of HTML: elements whose start or end breaks a line of text, those without content, those whose content is no text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg head noembed noframes".split())
#: Of those, the ones that take the rest of the page where nobody closes them; the others' content then counts as text.
ENDLESS = frozenset(("script", "style"))
#: A start of the first closes an open element of the second, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")

INLINE = frozenset("b i em strong span a u font small".split())
#: Steps that say little of the part of the page that holds a block.
PLAIN = INLINE | frozenset("p h1 h2 h3 li ul ol".split())


class Path:
    """Where a block stands: a step (tag and words of its names) below another place. What the labeller reads of all steps is kept as a mask of slots, so a place takes the same room at any depth."""

    __slots__ = ("depth", "holder", "inside", "kids", "slots", "step", "tag")

    def __init__(self, above: Path | None = None, step: str = ""):
        self.step, self.tag = step, step.split(" ", 1)[0]
        self.kids: dict[str, Path] = {}
        if above is None:
            self.depth, self.inside, self.holder, self.slots = 0, 0, 0, ()
            return
        self.depth = above.depth + 1
        inside, leaf, holder = _step_masks(step)
        self.inside = above.inside | inside
        self.holder = above.holder if self.tag in PLAIN else holder
        both = self.inside | leaf | self.holder | 1 << _path_slot(f"pair {above.tag} > {self.tag}" if above.depth else f"pair {self.tag}")
        self.slots = tuple(k for k in range(PATHS) if both >> k & 1)

    def below(self, step: str) -> Path:
        """The place one step further; the same one for the same step."""
        if (found := self.kids.get(step)) is None:
            found = self.kids[step] = Path(self, step)
        return found


Block = tuple[Path, str, int]


@lru_cache(maxsize=1 << 13)
def _described(tag: str, attributes: str) -> str:
    """A step of a path: the tag and the lower-cased words of its class, id and role."""
    words = [w for m in NAMES.finditer(attributes) for w in PART.findall((m[1] or m[2] or m[3] or "").lower())] if attributes else []
    return " ".join([tag, *words])


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: place, text, and how many of its characters are in links.

    Character references are decoded, white space in a block is one space, and blocks without text are left out. Tags that nobody
    closed end with what holds them; tags that nobody opened are ignored. Time and memory are linear in the page, however deep its
    tags are nested.
    """
    out: list[Block] = []
    stack: list[str] = []
    places: list[Path] = [Path()]
    open_at: dict[str, list[int]] = {}  # where in the stack each tag is
    parts: list[str] = []
    endless: set[str] = set()  # tags that nobody closes from here on
    links = linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((places[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        for tag in stack[k:]:
            open_at[tag].pop()
            links -= tag == "a"
        del stack[k:], places[k + 1 :]

    def last(tags) -> int:
        """Where in the stack the innermost of these tags is, or -1."""
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    n = len(page)
    while at < n:
        spot = page.find("<", at)
        if spot < 0:
            spot = n
        if spot > at:
            parts.append(page[at:spot])
            if links:
                linked += spot - at
        if spot == n:
            break
        if page.startswith("<!--", spot):
            end = page.find("-->", spot + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, spot) or LOOSE.match(page, spot)
        if not m:
            follow = page[spot + 1 : spot + 2]
            end = page.find(">", spot) if follow in ("!", "?", "/") else -1
            if end >= 0:
                at = end + 1
            elif follow.isalpha() or follow in ("!", "?", "/") and follow:
                break  # a tag that the page's end cuts off
            else:
                parts.append("<")
                at = spot + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if (k := last((tag,))) >= 0:
                pop_to(k)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            if m[3].endswith("/") and tag == "svg":
                continue
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "head":
                close = close or (None if tag in endless else re.compile("<body", re.I).search(page, at))
                at = (close.end() if close[0][:2] == "</" else close.start()) if close else at
            elif close:
                at = close.end()
            elif tag in ENDLESS:
                at = n
            if not close:
                endless.add(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if (k := last(("p",))) >= 0:
                pop_to(k)
            if tag in CLOSES:
                shut, until = CLOSES[tag]
                while (k := last(shut)) > last(until):
                    pop_to(k)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(tag)
        places.append(places[-1].below(_described(tag, m[3])))
        links += tag == "a"
    flush()
    return out


# Features: hashed steps of the path, hashed words, and a few measures.

PATHS, WORDS, MEASURES = 256, 128, 8
INPUTS = PATHS + WORDS + MEASURES


def _path_slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATHS


@lru_cache(maxsize=1 << 14)
def _step_masks(step: str) -> tuple[int, int, int]:
    """Slots of a step's words as one that holds a block, as the innermost one, and as the innermost that isn't plain."""
    masks = [0, 0, 0]
    for w in step.split():
        for k, kind in enumerate(("in", "leaf", "holder")):
            masks[k] |= 1 << _path_slot(f"{kind} {w}")
    return masks[0], masks[1], masks[2]


@lru_cache(maxsize=1 << 16)
def _word_slot(word: str) -> int:
    return PATHS + zlib.crc32(word.encode()) % WORDS


def features(page: list[Block], first: int = 0, upto: int | None = None) -> np.ndarray:
    """A row for each block from ``first`` on, with all its words and with the whole page in view."""
    n = len(page)
    some = page[first:upto]
    x = np.zeros((len(some), INPUTS), np.float32)
    for k, (place, text, linked) in enumerate(some):
        x[k, place.slots] = 1
        found = [_word_slot(w) for w in text.lower().split()]
        np.add.at(x[k], found, 1 / len(found))
        size = len(text)
        x[k, -MEASURES:] = (np.log1p(size) / 5, linked / size, text.count(" ") / size * 5, sum(map(text.count, ".,;")) / size * 10, text[-1:] in ".!?", min(place.depth, 50) / 10, (first + k) / n, min(n, 200) / 200)
    return x


class BiLSTM:
    """Two LSTMs over a page's blocks, one from either end, and a logistic unit on both states of each block."""

    def __init__(self, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, INPUTS**-0.5, (INPUTS, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.repeat(np.float32([0, 1, 0, 0]), hidden)
        self.p["o"] = r.normal(0, hidden**-0.5, 2 * hidden).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States for pages by blocks; the backward one runs over reversed pages. keep: gets what the gradient needs."""
        n, t, h = *x.shape[:2], self.h
        pre = x.reshape(n * t, -1) @ self.p[f"x{d}"] + self.p[f"c{d}"]
        pre = pre.reshape(n, t, 4 * h)
        out = np.zeros((n, t, h), np.float32)
        s = c = np.zeros((n, h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + s @ self.p[f"h{d}"]
            g = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[:, k, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            s2 = o * tc
            if keep is not None:
                keep.append((k, s, c, i, f, o, u, tc, m))
            c, s = m * c2 + (1 - m) * c, m * s2 + (1 - m) * s
            out[:, k] = s
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d) for d in "fb"], 2)
        return both @ self.p["o"] + self.p["ob"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, t, h = *x.shape[:2], self.h
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], 2)
        z = both @ self.p["o"] + self.p["ob"]
        prob = 1 / (1 + np.exp(-z))
        total = mask.sum()
        dz = (prob - y) * mask / total
        loss = -(np.log(np.where(y > 0.5, prob, 1 - prob) + 1e-9) * mask).sum() / total
        g = {"o": np.einsum("ntk,nt->k", both, dz), "ob": dz.sum(keepdims=True).reshape(1)}
        for half, d in enumerate("fb"):
            ds_out = dz[:, :, None] * self.p["o"][half * h : (half + 1) * h]
            dpre = np.zeros((n, t, 4 * h), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            ds = dc = np.zeros((n, h), np.float32)
            for k, s, c, i, f, o, u, tc, m in reversed(kept[d]):
                ds = ds + ds_out[:, k]
                own = ds * m
                dc2 = dc * m + own * o * (1 - tc * tc)
                dzk = np.concatenate([dc2 * u * i * (1 - i), dc2 * c * f * (1 - f), own * tc * o * (1 - o), dc2 * i * (1 - u * u)], 1)
                dpre[:, k] = dzk
                gh += s.T @ dzk
                ds, dc = dzk @ self.p[f"h{d}"].T + ds * (1 - m), dc2 * f + dc * (1 - m)
            flat = dpre.reshape(n * t, -1)
            g |= {f"x{d}": x.reshape(n * t, -1).T @ flat, f"h{d}": gh, f"c{d}": flat.sum(0)}
        return float(loss), g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 16, size: int = 32, rate: float = 0.02, decay: float = 1e-4, seed: int = 9) -> BiLSTM:
        """Adam over batches of pages of like length; a tenth of the inputs is blanked out in each, so that none alone decides."""
        r = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(rounds):
            by_size = np.argsort([len(y) + r.random() for _, y in pages])
            for a in r.permutation(np.arange(0, len(pages), size)):
                x, mask, y = padded([pages[k] for k in by_size[a : a + size]])
                x *= r.random(INPUTS) >= 0.1
                _, g = self.gradient(x, mask, y)
                step += 1
                for k, v in g.items():
                    v = v + decay * self.p[k]
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v * v - second[k])
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _long(self, page: list[Block], cells: int) -> np.ndarray:
        """scores for one long page, ``cells`` blocks at a time: what goes from one part to the next is the state, what stays of each block is a number."""
        n, h = len(page), self.h
        z = np.full(n, self.p["ob"][0], np.float32)
        starts = range(0, n, cells)
        for half, d in enumerate("fb"):
            u, o = self.p[f"h{d}"], self.p["o"][half * h : (half + 1) * h]
            s = c = np.zeros(h, np.float32)
            for a in starts if d == "f" else reversed(starts):
                x = features(page, a, a + cells)
                pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
                for k in range(len(pre)) if d == "f" else range(len(pre) - 1, -1, -1):
                    y = pre[k] + s @ u
                    g = 1 / (1 + np.exp(-y[: 3 * h]))
                    c = g[h : 2 * h] * c + g[:h] * np.tanh(y[3 * h :])
                    s = g[2 * h :] * np.tanh(c)
                    pre[k, :h] = s
                z[a : a + len(pre)] += pre[:, :h] @ o
        return z

    def labels(self, pages: list[list[Block]], cells: int = 40_000) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together, in groups of ``cells`` blocks, longer ones alone and part by part."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            if len(pages[order[-1]]) > cells:
                k = order.pop()
                out[k] = self._long(pages[k], cells // 4) > 0
                continue
            take = max(1, min(256, cells // len(pages[order[-1]])))
            group, order = order[-take:], order[:-take]
            x, mask, _ = padded([(features(pages[k]), np.zeros(len(pages[k]))) for k in group])
            z = self.scores(x, mask)
            for row, k in zip(z, group, strict=True):
                out[k] = row[: len(pages[k])] > 0
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), t, INPUTS), np.float32)
    mask, gold = np.zeros((2, len(pages), t), np.float32)
    for k, (own, y) in enumerate(pages):
        x[k, : len(y)], mask[k, : len(y)], gold[k, : len(y)] = own, 1, y
    return x, mask, gold


# Training pages: made by rule, from a seed. A main block's text begins with a mark that is taken off again.

MARK = "\x02"
SYLLABLES = "an be cor da el fin go hal is jo ka lem mi nor os pa qui ra sol ta un ver wa yes zon é ü".split()
SIDE = "sidebar menu navigation widget related promo banner share social breadcrumb toolbar links tags newsletter subscribe cookie consent notice alert ad ads advert sponsor comments comment respond reply login search popup modal disclaimer copyright".split()
MAIN = "content main post entry story article text body page section column".split()


def make_page(r: random.Random) -> str:
    word = lambda: "".join(r.choices(SYLLABLES, k=r.randint(1, 3)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", "", "!"])
    name = lambda own: r.choice([f' class="{own}"', f" id={own}", f' class="{word()} {own}"', f" class='{own}-{word()}'"])

    def items(main: str) -> str:
        inner = (lambda t: t) if main or r.random() < 0.2 else (lambda t: f'<a href="/{word()}">{t}</a>')
        return f"<{(k := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{main}{inner(say(1, 4) if not main else say(4, 20))}</li>" for _ in range(r.randint(2, 6))) + f"</{k}>"

    def side() -> str:
        tag = r.choice(["nav", "aside", "header", "footer", "form", "div", "div", "div", "section"])
        own = name(r.choice(SIDE)) if tag in ("div", "section") or r.random() < 0.3 else ""
        if tag == "form":
            inner = f"<label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button>"
        else:
            inner = r.choice([items(""), f"<p>{say(3, 30)}</p>", say(2, 25), f"<h3>{say(1, 4)}</h3>{items('')}", f"<p>{say(5, 40)}</p><p>{say(5, 40)}</p>", f"&copy; {word()} &middot; {say(3, 12)}", f"<a href=#>{say(1, 3)}</a>"])
        return f"<{tag}{own}>{inner}</{tag}>"

    def body() -> str:
        out = [f"<h1>{MARK}{say(3, 12)}</h1>"] * (r.random() < 0.85)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p>{r.choice(['', '', '<b>', '<em>'])}{MARK}{say(2, 90)}{r.choice(['', '<br>'])}{r.choice(['</p>', '</p>', ''])}")
            elif kind < 0.76:
                out.append(f"<h2>{MARK}{say(2, 7)}</h2>")
            elif kind < 0.82:
                out.append(items(MARK))
            elif kind < 0.87:
                out.append(f"<blockquote>{MARK}{say(8, 40)}</blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{say(1, 4)}</td><td>{MARK}{say(1, 4)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(r.choice([f"<div{name(r.choice(SIDE))}>{say(2, 25)}</div>", f"<aside>{say(3, 20)}</aside>", f"<div{name(r.choice(SIDE))}>{items('')}</div>", f"<div{name(r.choice(SIDE))}><p>{say(3, 25)}</p></div>"]))
        return "".join(out)

    holder = r.choice(["article", "article", "article", "main", "div", "section"])
    own = name(r.choice(MAIN)) if holder in ("div", "section") or r.random() < 0.3 else ""
    inner = f"<{holder}{own}>{body()}</{holder}>"
    if r.random() < 0.3:
        inner = f"<main>{inner}</main>" if holder == "article" else f"<div{name(r.choice(MAIN))}>{inner}</div>"
    before = "".join(side() for _ in range(r.randint(0, 4)))
    after = "".join(side() for _ in range(r.randint(0, 4)))
    if r.random() < 0.3:
        after = f"<{(k := r.choice(['section', 'div']))} class=comments><h2>{say(1, 3)}</h2>" + "".join(f"<div class=comment><p>{say(3, 40)}</p></div>" for _ in range(r.randint(1, 4))) + f"</{k}>" + after
    end = "" if r.random() < 0.1 else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title><script>var x='</p>';</script></head><body>{before}{inner}{after}{end}"


def make_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        if found := blocks(make_page(r)):
            out.append(([(p, t.replace(MARK, ""), k) for p, t, k in found], np.array([MARK in t for _, t, _ in found], np.float32)))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 3) -> BiLSTM:
    return BiLSTM().fit([(features(p), y) for p, y in make_pages(pages, seed)])


def extract(pages: DataFrame, *, column: str = "html", model: BiLSTM | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html: the main blocks in page order, joined by newlines.

    Null and empty pages, and pages without main blocks, give an empty text of 0 code points. Each page is read whole and labelled
    with all its blocks in view; nothing is shuffled. Each row is read by itself, so repeated rows give equal rows, and an empty
    table an empty table. Memory is in proportion to the longest page. The model has a fixed size and is trained on the driver on a
    fixed number of made pages. Columns by the names of the result are replaced.
    """
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if c != column]
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            found = [blocks(x) for x in text_of(batch.column(column))]
            texts = ["\n".join(t for (_, t, _), keep in zip(page, y, strict=True) if keep) for page, y in zip(found, shared.value.labels(found), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.mapInArrow(run, f"{fields}text string, n_chars long")
