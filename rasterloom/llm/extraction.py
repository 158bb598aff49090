"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: maximal runs of text between block-level tags, each with
the path of its ancestors. Scripts, styles, templates, frames, text areas, selections, the
head, comments and elements hidden by attribute or style are not text. Character references
are decoded, white space inside a block becomes one space; a line break is white space.
The page is scanned once: open elements are kept with their places by name and a count of
each feature that the field knows, so time and memory grow with the page's length, however
deep its elements lie. Every block gets features of its ancestors (tag
names and the words of class, id and role), of its text (length, share of linked text,
signs, ending) and of its place; labels are "main" and "other". Weights of features and of
the four label transitions are trained by maximum likelihood (forward-backward, gradient
ascent with adaptive steps) on labelled pages, and the best label sequence is found by
Viterbi. Main blocks are joined by a line feed in page order.

The labelled pages are written by labelled_pages() from templates of articles with menus,
headers, footers, sidebars, notices, adverts, forms and comments around them, as no
labelled pages come with the data. Training takes the same few seconds at every size.

Defined results: a null or empty html gives an empty text; broken or unclosed tags are
handled as browsers do for paragraphs, list items and cells; an attribute whose quote is
never closed ends at the next >; a page without main blocks has an empty text; of two
equally likely labels the block is not main; very long pages are read whole; repeated rows,
and rows with null page_id or url, are extracted each; extra columns are not read; an empty
table gives none.
"""

from __future__ import annotations

import html as _html
import pickle
import random
import re
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.scratch import share

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style template textarea iframe select title head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes these open elements, up to the nearest of those that hold them.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"[^>=]*")
_VALUE = re.compile(r"\s*([^\s>\"'][^\s>]*)?")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]{2,}")


class _Open:
    """The open elements: places by name, distinct features, and whether text in them is linked or hidden."""

    def __init__(self, known: Container[str] | None):
        self.known, self.stack = known, []
        self.places: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {}
        self.hidden: int | None = None
        self._path: tuple[str, ...] | None = ()

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((at[-1] for at in map(self.places.get, names) if at), default=-1)

    def push(self, name: str, features: list[str], hidden: bool) -> None:
        features = [f for f in features if self.known is None or f in self.known]
        self.places.setdefault(name, []).append(len(self.stack))
        if hidden and self.hidden is None:
            self.hidden = len(self.stack)
        self.stack.append((name, features))
        for f in features:
            self.counts[f] = self.counts.get(f, 0) + 1
            self._path = None

    def cut(self, place: int) -> None:
        """Close the element at the place and all inside it."""
        while len(self.stack) > place:
            name, features = self.stack.pop()
            self.places[name].pop()
            for f in features:
                self._path = None
                self.counts[f] -= 1
                if not self.counts[f]:
                    del self.counts[f]
        if self.hidden is not None and self.hidden >= place:
            self.hidden = None

    def path(self) -> tuple[str, ...]:
        if self._path is None:
            self._path = tuple(self.counts)
        return self._path


def _tag_end(page: str, at: int, closed: dict[str, bool]) -> tuple[int, str]:
    """Place of the > that ends the tag whose attributes start here (the page's length if none), and the text outside attribute values."""
    outside = []
    while True:
        m = _NAMES.match(page, at)
        outside.append(m[0])
        at = m.end()
        if at >= len(page) or page[at] == ">":
            return at, " ".join(outside)
        at = _VALUE.match(page, at + 1).end()
        if at < len(page) and page[at] in "\"'" and page[at - 1] in "= \t\r\n\f":
            quote = page[at]
            end = page.find(quote, at + 1) if closed[quote] else -1
            if end < 0:
                closed[quote] = False  # no later search can find it
                end = page.find(">", at + 1)
                return (len(page) if end < 0 else end), " ".join(outside)
            at = end + 1


def blocks(page: str, known: Container[str] | None = None) -> list[tuple[tuple[str, ...], str, float]]:
    """(distinct features of the ancestors, text, share of it inside links) of each leaf block, in page order; features outside known are left out."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    open_ = _Open(known)
    parts: list[str] = []
    linked = 0
    closed, head_ends = {'"': True, "'": True}, True

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", _html.unescape(raw)).strip()
            if text:
                out.append((open_.path(), text, min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if open_.hidden is None and piece:
            parts.append(piece)
            if open_.places.get("a"):
                linked += len(piece.strip())

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        say(page[at:start])
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            continue
        if page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, at)
        if m is None:
            say("<")
            continue
        name = m[1].lower()
        end, outside = _tag_end(page, m.end(), closed)
        attributes, ending = page[m.end() : end], page[at] == "/"
        at = end + 1
        if ending:
            if name == "br" or name in _BLOCK:
                flush()
            place = open_.last(name)
            if place >= 0:
                open_.cut(place)
            continue
        if name in _RAW:
            if name != "head":
                found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = n if found is None else found.end()
            elif head_ends:
                found = _HEAD_END.search(page, at)
                head_ends = found is not None
                if found is not None:
                    at = found.end() if page[found.start() + 1] == "/" else found.start()
            continue
        if name == "br":
            say(" ")
            continue
        if name in _BLOCK:
            flush()
            if open_.places.get("p") and name not in ("button", "caption", "legend", "summary"):
                open_.cut(open_.last("p"))
            if name in _CLOSES:
                closes, holds = _CLOSES[name]
                place = open_.last(*closes)
                if place > open_.last(*holds):
                    open_.cut(place)
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            words, hidden = [], "hidden" in outside.lower().split()
            for a in _ATTR.finditer(attributes):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "style":
                    hidden = hidden or _HIDDEN.search(value) is not None
                else:
                    words += _WORD.findall(value.lower())
            open_.push(name, [f"t:{name}", *(f"c:{w}" for w in dict.fromkeys(words))] if name in _BLOCK or words else [], hidden)
    flush()
    return out


def features(page_blocks: list[tuple[tuple[str, ...], str, float]]) -> list[list[str]]:
    out, n = [], len(page_blocks)
    for i, (path, text, linked) in enumerate(page_blocks):
        words = text.count(" ") + 1
        f = ["b", *path, f"n{min(7, words.bit_length())}", f"l{int(linked * 3)}"]
        if text[-1] in ".!?":
            f.append("stop")
        if "©" in text or "copyright" in text.lower():
            f.append("copy")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


class Crf:
    """Two labels; weights per feature and label, and per pair of labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, fs: list[list[str]]) -> list[int]:
        """The most probable labels: Viterbi."""
        w, ((m00, m01), (m10, m11)) = self.weights, self.moves.tolist()
        s0 = s1 = 0.0
        back: list[tuple[int, int]] = []
        for i, f in enumerate(fs):
            e0 = e1 = 0.0
            for x in f:
                p = w.get(x)
                if p:
                    e0 += p[0]
                    e1 += p[1]
            if i == 0:
                s0, s1 = e0, e1
                continue
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b > a), int(d > c)))
            s0, s1 = max(a, b) + e0, max(c, d) + e1
        out = [int(s1 > s0)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1] if fs else []

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 80, step: float = 0.2, decay: float = 1e-3) -> Crf:
        names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for row in fs for f in row}))}
        rows = [[np.array([names[x] for x in f]) for f in fs] for fs, _ in pages]
        flat = np.concatenate([r for page in rows for r in page])
        size = np.array([len(r) for page in rows for r in page])
        block = np.repeat(np.arange(len(size)), size)
        first = np.concatenate([[0], np.cumsum([len(p) for p in rows])])
        truth = np.concatenate([y for _, y in pages])
        longest = max(len(p) for p in rows)
        pad = np.full((len(pages), longest), -1)
        for i in range(len(pages)):
            pad[i, : first[i + 1] - first[i]] = np.arange(first[i], first[i + 1])
        has = pad >= 0
        w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
        want_w = np.zeros_like(w)
        np.add.at(want_w, (flat, truth[block]), 1.0)
        want_m = np.zeros((2, 2))
        inner = has[:, 1:]
        np.add.at(want_m, (truth[pad[:, :-1][inner]], truth[pad[:, 1:][inner]]), 1.0)
        g2w, g2m = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
        for _ in range(rounds):
            e = np.zeros((len(size), 2))
            for y in (0, 1):
                e[:, y] = np.bincount(block, w[flat, y], len(size))
            x = np.where(has[..., None], e[pad], 0.0)
            alpha, beta = np.zeros_like(x), np.zeros_like(x)
            alpha[:, 0] = x[:, 0]
            for t in range(1, longest):
                new = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + x[:, t]
                alpha[:, t] = np.where(has[:, t, None], new, alpha[:, t - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for t in range(longest - 2, -1, -1):
                after = x[:, t + 1] + beta[:, t + 1]
                new = np.logaddexp(moves[:, 0] + after[:, 0, None], moves[:, 1] + after[:, 1, None])
                beta[:, t] = np.where(has[:, t + 1, None], new, 0.0)
            p = np.exp(alpha + beta - z[:, None, None])[has]
            mine = np.zeros_like(p)
            mine[pad[has]] = p
            got_w = np.stack([np.bincount(flat, mine[block, y], len(names)) for y in (0, 1)], 1)
            got_m = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    q = np.exp(alpha[:, :-1, a] + moves[a, b] + x[:, 1:, b] + beta[:, 1:, b] - z[:, None])
                    got_m[a, b] = q[inner].sum()
            gw, gm = want_w - got_w - decay * w * len(pages), want_m - got_m - decay * moves * len(pages)
            g2w, g2m = g2w + gw**2, g2m + gm**2
            w, moves = w + step * gw / np.sqrt(g2w), moves + step * gm / np.sqrt(g2m)
        return cls({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, moves)


def _prose(r: random.Random, words: int) -> str:
    letters = "aeiou", "bcdfghlmnprstvw"
    out = ["".join(r.choice(letters[k % 2]) for k in range(r.randint(2, 9))) for _ in range(words)]
    for i in range(len(out)):
        if r.random() < 0.1:
            out[i] += r.choice(",.%$&")
    return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!"])


def labelled_pages(count: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages and their main blocks, from templates."""
    r = random.Random(seed)
    pages = []
    for _ in range(count):
        p = lambda lo, hi: _prose(r, r.randint(lo, hi))
        links = lambda n: "".join(f'<li><a href="/x">{p(1, 3)}</a></li>' for _ in range(n))
        main: list[str] = []

        def own(tag: str, text: str, main: list[str] = main) -> str:
            main.append(text)
            inner = f"<b>{text}</b>" if r.random() < 0.1 else f"<b>{text}<br>" if r.random() < 0.1 else text
            return f"<{tag}>{inner}" + (f"</{tag}>" if r.random() < 0.9 or tag != "p" else "")

        article = own("h1", p(2, 12)) if r.random() < 0.9 else ""
        for _ in range(r.choice([0, 1, 3, 6, 12, 20])):
            kind = r.random()
            article += own("h2", p(1, 8)) if kind < 0.1 else own("blockquote", p(4, 40)) if kind < 0.14 else "<ul>" + own("li", p(1, 20)) + own("li", p(2, 12)) + "</ul>" if kind < 0.2 else own("p", p(1, 3) if r.random() < 0.2 else p(4, 90))
        around = [
            f'<header><div class="{r.choice(["logo", "brand", "site-header"])}">{p(1, 4)}</div></header>',
            f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>",
            f'<div class="{r.choice(["menu", "navbar", "breadcrumb", "nav"])}"><ul>{links(r.randint(2, 8))}</ul></div>',
            f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "banner promo", "ad-slot"])}">{p(2, 30)}</div>',
            f'<div class="{r.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter"])}"><p>{p(4, 30)}</p><button>{p(1, 2)}</button></div>',
            f'<aside class="{r.choice(["sidebar", "related", "widget", "side"])}"><h3>{p(1, 4)}</h3><ul>{links(r.randint(1, 6))}</ul><p>{p(3, 25)}</p></aside>',
            f"<form><label>{p(1, 3)}</label><input name=q><button>{p(1, 2)}</button><p>{p(2, 12)}</p></form>",
        ]
        after = [
            f'<{r.choice(["section", "div"])} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "replies", "discussion"])}"><h3>{p(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{p(3, 50)}</p></div>' for _ in range(r.randint(1, 4))) + "</section></div>",
            f'<div class="{r.choice(["share", "social", "tags", "related", "sidebar", "widget"])}"><ul>{links(r.randint(1, 5))}</ul></div>',
            f"<aside><p>{p(3, 40)}</p></aside>",
            f"<footer>&copy; {p(1, 3)} &middot; {p(3, 14)}</footer>",
            f'<div class="{r.choice(["footer", "copyright", "legal"])}">{p(3, 20)}</div>',
            f'<div class="ad">{p(2, 30)}</div>',
        ]
        head = "".join(x for x in around if r.random() < 0.45)
        tail = "".join(x for x in after if r.random() < 0.45)
        wrap = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="{c}">{}</div>', '<div id="{c}">{}</div>'])
        body = wrap.replace("{c}", r.choice(["content", "article-body", "post", "entry-content", "main", "story"])).replace("{}", article)
        if r.random() < 0.15:  # an advert inside the article
            body = body.replace("<p>", f'<div class="ad">{p(2, 20)}</div><p>', 1)
        pages.append((f"<!DOCTYPE html><html><head><title>{p(2, 5)}</title></head><body>{head}{body}{tail}</body></html>", main))
    return pages


def trained(pages: list[tuple[str, list[str]]] | None = None) -> Crf:
    data = []
    for page, main in pages or labelled_pages():
        found = blocks(page)
        if not found:
            continue
        left = list(main)
        labels = []
        for _, text, _ in found:
            want = _SPACE.sub(" ", _html.unescape(left[0])).strip() if left else None
            labels.append(int(text == want))
            if text == want:
                left.pop(0)
        data.append((features(found), labels))
    return Crf.train(data)


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page or "", crf.weights)
    return "\n".join(b[1] for b, y in zip(found, crf.decode(features(found)), strict=True) if y) if found else ""


def extract(spark: SparkSession, pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    shared = share(spark, crf or trained())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = pickle.loads(shared.value)
        for b in batches:
            texts = [main_text(x.as_py(), crf) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(f, "page_id long, url string, text string, n_chars long")
