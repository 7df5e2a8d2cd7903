"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text that no block element interrupts. A block's features
are the tags and the class and id words of its ancestors, and shape features of its text; the
labels are main text or not, with a weight for each pair of neighbouring labels. The weights are
trained here, on labelled pages from `labelled_pages`, by gradient ascent on the conditional
likelihood; pages are decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element names of HTML that matter to the cutting into blocks.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
HIDDEN = RAW - {"title"}
#: Start tags that end an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Block:
    """A leaf block's text and features; `known` keeps to features that the model has a weight for."""

    __slots__ = ("features", "text")

    def __init__(self, around: Iterable[str], leaf: str, text: str, linked: int, size: int):
        self.text = text
        words = text.count(" ") + 1
        own = [f"leaf {leaf}", f"words {min(words.bit_length(), 7)}", f"linked {4 * linked // max(1, size)}", f"ends {'stop' if text[-1] in '.!?' else 'other'}"]
        if any(c in text for c in "\u00a9|\u00bb\u00b7\u2022"):
            own.append("sign")
        self.features = sorted({*around, *own})


class _Open:
    """The open elements: for each the features that its ancestors and it bring in, counted, so that no block copies the stack."""

    def __init__(self, known: Container[str] | None):
        self.known, self.names, self.brought = known, [], []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.shown: list[int] = []
        self.features: dict[str, int] = {}

    def push(self, name: str, words: tuple[str, ...]) -> None:
        at = len(self.names)
        shown = name in BLOCK or bool(words)
        brought = [f for f in {f"in {name}", *(f"named {w}" for w in words)} if self.known is None or f in self.known] if shown else []
        for f in brought:
            self.features[f] = self.features.get(f, 0) + 1
        self.names.append(name)
        self.brought.append(brought)
        self.places.setdefault(name, []).append(at)
        if name in BLOCK:
            self.blocks.append(at)
        if shown:
            self.shown.append(at)

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            at, name = len(self.names) - 1, self.names.pop()
            self.places[name].pop()
            for pile in (self.blocks, self.shown):
                if pile and pile[-1] == at:
                    pile.pop()
            for f in self.brought.pop():
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]

    def last(self, name: str) -> int | None:
        pile = self.places.get(name)
        return pile[-1] if pile else None

    def leaf(self) -> str:
        return self.names[self.shown[-1]] if self.shown else "none"


def blocks_of(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order, with decoded text and white space in them (of Unicode, so also no-break spaces) made one space.

    Time grows with the page's length, however deep its elements are nested.
    """
    out: list[Block] = []
    open_ = _Open(known)
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                out.append(Block(open_.features, open_.leaf(), text, sum(len(p) for p, a in parts if a), sum(len(p) for p, _ in parts)))
            parts.clear()

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            parts.append((page[at:end], bool(open_.places.get("a"))))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            depth = open_.last(name)
            if depth is not None and (name in BLOCK or not open_.blocks or open_.blocks[-1] <= depth):
                open_.cut(depth)
            continue
        if name in BLOCK:
            flush()
            if open_.blocks:
                inner = open_.blocks[-1]
                if open_.names[inner] == "p" or open_.names[inner] in CLOSES.get(name, ()):
                    open_.cut(inner)
        if name == "br":
            parts.append((" ", bool(open_.places.get("a"))))
        if name in VOID or m[3].endswith("/>") and name in HIDDEN:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name == "title":
                parts.append((page[at : close.start() if close else len(page)], False))
                open_.push(name, ())
                flush()
                open_.cut(len(open_.names) - 1)
            at = close.end() if close else len(page)
            continue
        names = " ".join(x for g in _NAMES.findall(m[3]) for x in g if x).lower() if "=" in m[3] else ""
        open_.push(name, tuple(_WORD.findall(names)))
    flush()
    return out


# Names that pages give their parts, for the labelled pages.
_MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "main-content"), ("div", "article-body"), ("div", "entry-content"), ("div", "post-content"), ("section", "story"), ("div", "text"), ("div", "post"), ("article", "post"), ("div", "body"), ("td", "content"), ("article", "entry")]
_REST = {
    "links": [("nav", ""), ("ul", "menu"), ("div", "nav"), ("div", "navbar"), ("div", "menu"), ("div", "breadcrumb"), ("ul", "breadcrumbs"), ("div", "pagination"), ("nav", "toc"), ("div", "tags"), ("div", "share"), ("div", "social"), ("div", "related"), ("aside", "related-posts"), ("div", "navigation"), ("div", "links"), ("div", "topbar")],
    "short": [("header", ""), ("div", "header"), ("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright"), ("div", "masthead"), ("div", "banner"), ("div", "cookie-notice"), ("div", "cookie"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("div", "newsletter"), ("div", "subscribe"), ("div", "byline-meta")],
    "prose": [("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "widget"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("aside", "ad"), ("section", "promotion"), ("div", "teaser"), ("div", "gdpr"), ("section", "ad"), ("div", "disclaimer"), ("div", "legal")],
    "comments": [("section", "comments"), ("div", "comments"), ("ol", "comment-list"), ("div", "comment"), ("div", "disqus"), ("ul", "commentlist"), ("section", "responses"), ("div", "replies"), ("section", "discussion"), ("div", "reviews")],
    "form": [("form", ""), ("form", "search"), ("div", "login-form"), ("form", "subscribe"), ("fieldset", "")],
}


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages with the label of each of their blocks: 1 for main text. Invented words, parts and orders drawn at random."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    some = lambda p: rng.random() < p
    syllables = ["ba", "ne", "ri", "to", "lu", "ka", "mes", "dor", "vin", "pel", "sta", "gro"]

    def prose(lo: int, hi: int) -> str:
        words = ["".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi)))]
        for i in range(0, len(words), 9):
            words[i] = words[i].capitalize()
            if i:
                words[i - 1] += "."
        return " ".join(words) + ("." if some(0.9) else "")

    pages = []
    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def put(tag: str, text: str, label: int) -> None:
            out.append(f"<{tag}>{text}</{tag.split()[0]}>")
            labels.append(label)

        def opened(tag: str, name: str) -> str:
            attribute = pick(["class", "class", "id"])
            return f'<{tag} {attribute}="{name}">' if name else f"<{tag}>"

        def rest(kind: str) -> None:
            tag, name = pick(_REST[kind])
            out.append(opened(tag, name))
            inner = "li" if tag in ("ul", "ol") else pick(["p", "div", "span"])
            if tag not in ("ul", "ol") and kind in ("links", "comments", "form") and some(0.3):  # parts of a page have headings, too
                put(pick(["h2", "h3", "h4"]), prose(1, 4)[:-1], 0)
            if kind == "links":
                for _ in range(int(rng.integers(2, 8))):
                    put("li" if inner == "li" or some(0.6) else "div", f'<a href="/x">{prose(1, 4)[:-1]}</a>', 0)
            elif kind == "comments":
                for _ in range(int(rng.integers(1, 5))):
                    put(pick(["li", "p", "div", 'p class="comment-text"', 'div class="comment"', 'div class="reply"']), prose(3, 60), 0)
            elif kind == "form":
                put("label", prose(1, 4), 0) if some(0.01) else put("p", prose(1, 6), 0)
                out.append("<input name=q><button>")
                out.append(prose(1, 3) + "</button>")
                labels.append(0)
            else:
                if kind == "prose" and some(0.4):  # a heading, and mostly links, as sidebars have them
                    put(pick(["h2", "h3", "h4", "p", "strong"]), prose(1, 4)[:-1], 0)
                    if some(0.6):
                        out.append("<ul>")
                        for _ in range(int(rng.integers(1, 5))):
                            put("li", f'<a href="/z">{prose(1, 6)[:-1]}</a>', 0)
                        out.append("</ul>")
                for _ in range(int(rng.integers(1, 3))):
                    text = prose(2, 12) if kind == "short" else prose(3, 40)
                    put("p" if inner == "span" else inner, ("&copy; " if kind == "short" and some(0.3) else "") + text, 0)
            out.append(f"</{tag}>")

        out.append("<html><head><title>" + prose(2, 9) + "</title></head><body>")
        labels.append(0)
        for _ in range(int(rng.integers(0, 5))):
            rest(pick(["links", "short", "prose", "form", "links"]))
        mark = pick(["", "", "", "", "", " |", " \u00b7", "\u2022", "***", "\u00a9"])  # some articles are full of signs

        def own(lo: int, hi: int, mark: str = mark) -> str:
            return " ".join(w + mark for w in prose(lo, hi).split(" "))

        tag, name = pick(_MAIN)
        wrapped = some(0.4)
        if wrapped:
            out.append(opened("div", pick(["wrapper", "page", "container", "site", "layout"])))
        out.append(opened(tag, name))
        if some(0.7):
            put(pick(["h1", "h2"]), own(2, 12), 1)
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            if kind < 0.75:
                put("p", own(1, 90) + (f' <a href="/y">{own(1, 3)}</a> {own(2, 20)}' if some(0.2) else ""), 1)
            elif kind < 0.83:
                put(pick(["h2", "h3"]), own(1, 7)[:-1], 1)
            elif kind < 0.9:
                out.append("<ul>")
                for _ in range(int(rng.integers(2, 5))):
                    put("li", own(2, 15), 1)
                out.append("</ul>")
            elif kind < 0.94:
                out.append("<blockquote>")
                put("p", own(4, 40), 1)
                out.append("</blockquote>")
            elif kind < 0.955:
                put("pre", own(3, 20), 1)
            elif kind < 0.98:
                out.append("<table>")
                for _ in range(int(rng.integers(1, 4))):
                    out.append("<tr>")
                    for _ in range(int(rng.integers(2, 4))):
                        put(pick(["td", "td", "th"]), own(1, 8)[:-1], 1)
                    out.append("</tr>")
                out.append("</table>")
            else:
                rest(pick(["prose", "links", "form", "short"]))
        if some(0.15):
            rest("comments")
        out.append(f"</{tag}>")
        for _ in range(int(rng.integers(0, 5))):
            rest(pick(["links", "short", "prose", "comments", "form", "comments"]))
        out.append("</div></body></html>" if wrapped else "</body></html>")
        pages.append(("".join(out), labels))
    return pages


@cache
def train(n: int = 400, rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> tuple[dict[str, float], tuple[float, float, float, float]]:
    """Weights: of each feature for main text, and of the label pairs 00, 01, 10, 11."""
    pages = [([b.features for b in blocks_of(page)], labels) for page, labels in labelled_pages(n)]
    assert all(len(f) == len(y) for f, y in pages)
    names = sorted({x for f, _ in pages for b in f for x in b})
    place = {x: i for i, x in enumerate(names)}
    longest = max(len(y) for _, y in pages)
    live = np.array([[t < len(y) for t in range(longest)] for _, y in pages])
    gold = np.array([y + [0] * (longest - len(y)) for _, y in pages])
    x = np.zeros((*live.shape, len(names)), np.float32)
    for p, (f, _) in enumerate(pages):
        for t, b in enumerate(f):
            x[p, t, [place[name] for name in b]] = 1
    both = live[:, 1:] & live[:, :-1]
    seen = np.array([[(both & (gold[:, :-1] == i) & (gold[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights, pair = np.zeros(len(names)), np.zeros((2, 2))
    square, pair_square = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        one = x @ weights
        local = np.stack([np.zeros_like(one), one], axis=2)
        ahead, behind = local.copy(), np.zeros_like(local)
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pair, axis=1) + local[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(pair + (local[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead + behind - total[:, None, None])[:, :, 1]
        gradient = np.einsum("pt,ptf->f", (gold - chance) * live, x) - decay * len(pages) * weights
        pairs = np.exp(ahead[:, :-1, :, None] + pair + (local + behind)[:, 1:, None, :] - total[:, None, None, None])
        pair_gradient = seen - (pairs * both[:, :, None, None]).sum(axis=(0, 1))
        square, pair_square = square + gradient**2, pair_square + pair_gradient**2
        weights += rate * gradient / np.sqrt(square)
        pair += rate * pair_gradient / np.sqrt(pair_square)
    return {n: float(w) for n, w in zip(names, weights, strict=True)}, tuple(pair.ravel().tolist())


def decode(features: list[list[str]], weights: dict[str, float], pair: tuple[float, float, float, float]) -> list[int]:
    """The likeliest labels, by Viterbi; main text wins ties."""
    rest, main, back = 0.0, 0.0, []
    for t, own in enumerate(features):
        score = sum(weights.get(x, 0.0) for x in own)
        if t == 0:
            rest, main = 0.0, score
            continue
        a, b, c, d = rest + pair[0], main + pair[2], rest + pair[1], main + pair[3]
        back.append((b >= a, d >= c))
        rest, main = max(a, b), max(c, d) + score
    label = int(main >= rest)
    out = [label]
    for from_main in reversed(back):
        label = int(from_main[label])
        out.append(label)
    return out[::-1][: len(features)]


def main_text(page: str | None, weights: dict[str, float], pair: tuple[float, float, float, float]) -> str:
    blocks = blocks_of(page or "", weights)
    if not blocks:
        return ""
    labels = decode([b.features for b in blocks], weights, pair)
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row's whole html.

    The text is the main text's blocks, joined by an empty line. Null or empty html, and pages
    without main text: the empty string. Rows are judged each for itself, whatever repeats; an empty
    table gives no rows; further columns are ignored. A page is worked on whole, in one task.
    """
    weights, pair = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                text = pa.array([main_text(x.as_py(), weights, pair) for x in part.column("html")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
