"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags, with the tags open around them. Each
block has features of its ancestors (tags, class and id words) and of its text (length, links, stops). A chain with
two labels, text and other, is trained on labelled pages and decoded by Viterbi; the text blocks are the main text.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks

BITS = 12

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript template head title svg iframe object textarea select".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table article section div body aside nav main form".split())

RAW = frozenset("script style noscript template svg iframe object textarea select title".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN = re.compile(r"[^'\">]*")
NAMES = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
DIGIT = re.compile(r"\d")
WHITE = re.compile(r"[ \t\n\r\f\v   ]+")


@dataclass
class Block:
    own: str  #: the innermost block-level tag
    around: frozenset[int]  #: features of all tags around it, with their class and id words
    text: str
    linked: int  #: characters inside links


@lru_cache(1 << 16)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


class Tags:
    """A page's tags in order, in time that follows its length whatever the markup."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last_end = page.rfind(">")
        self.last_quote = {q: page.rfind(q) for q in "'\""}
        self.careful = False
        self._dead: set[int] = set()  # places outside quotes from which a tag's end isn't found

    def _end(self, at: int) -> int | None:
        """The first > from ``at`` on that no quotes hold; where a quote isn't closed, None. No place is tried twice."""
        tried = []
        while at not in self._dead:
            tried.append(at)
            at = PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                break
            quote = self.page[at]
            if quote == ">":
                return at
            if at >= self.last_quote[quote]:
                break
            at = self.page.index(quote, at + 1) + 1
        self._dead.update(tried)
        return None

    def tag(self, at: int) -> tuple[int, bool, str, str] | None:
        """End, whether it closes, name and attributes of the tag at a <; None if it isn't one. A tag with an unclosed
        quote ends at its first >."""
        if at > self.last_end:
            return None
        if not self.careful:
            if m := TAG.match(self.page, at):
                return m.end(), bool(m[1]), m[2].lower(), m[3]
        m = TAG_NAME.match(self.page, at)
        if not m:
            return None
        self.careful = True
        end = self._end(m.end())
        end = self.page.index(">", at) if end is None else end
        return end + 1, bool(m[1]), m[2].lower(), self.page[m.end() : end]

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """Begin, end, whether it closes, name and attributes; a comment and such have no name. A raw element is one tag
        up to its end."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                yield at, (end := len(page) if end < 0 else end + 3), False, "", ""
            elif page[at + 1 : at + 2] in ("!", "?") and at < self.last_end:
                yield at, (end := page.index(">", at) + 1), False, "", ""
            elif (found := self.tag(at)) is None:
                at += 1
                continue
            else:
                end, closes, name, attributes = found
                if name in RAW and not closes:
                    m = RAW_END[name].search(page, end)
                    end, name = (m.end() if m else len(page)), ""
                yield at, end, closes, name, attributes
            at = end


RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}


class _Open:
    """The open block-level tags. Each knows the features of all around it, whether it is unseen, the inline tags that
    are open directly in it, and the place of the nearest scope."""

    def __init__(self) -> None:
        self.tags, self.around, self.unseen, self.scope = [""], [frozenset()], [False], [0]
        self.inline: list[Counter[str]] = [Counter()]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.links = 0

    def push(self, tag: str, names: str) -> None:
        more = {_bucket(f"in={tag}")} | {_bucket(f"name={w}") for w in WORDS.findall(names.lower())}
        around = self.around[-1]
        self.places[tag].append(len(self.tags))
        self.scope.append(len(self.tags) if tag in SCOPES else self.scope[-1])
        self.tags.append(tag)
        self.around.append(around if more <= around else around | more)
        self.unseen.append(self.unseen[-1] or tag in UNSEEN)
        self.inline.append(Counter())

    def pop_to(self, k: int) -> None:
        while len(self.tags) > k:
            self.places[self.tags.pop()].pop()
            self.links -= self.inline.pop()["a"]
            for held in (self.around, self.unseen, self.scope):
                held.pop()

    def nearest(self, tags: list[str]) -> int:
        """The innermost of these tags, if no scope is inside it; else 0."""
        at = max(self.places[t][-1] if self.places[t] else 0 for t in tags)
        return at if at > self.scope[-1] else 0


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Tags may be unclosed or closed out of order."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal parts, linked
        if parts and not opened.unseen[-1]:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(opened.tags[-1], opened.around[-1], text, linked))
        parts, linked = [], 0

    for begin, end, closes, tag, attributes in Tags(page):
        if begin > at:
            parts.append(page[at:begin])
            linked += (begin - at) if opened.links else 0
        at = end
        if not tag:
            continue
        if tag in INLINE:
            own = opened.inline[-1]
            if closes and own[tag]:
                own[tag] -= 1
                opened.links -= tag == "a"
            elif not closes and tag == "br":
                parts.append(" ")
            elif not closes and tag not in VOID:
                own[tag] += 1
                opened.links += tag == "a"
        elif closes:
            if opened.places[tag]:
                close()
                opened.pop_to(opened.places[tag][-1])
        else:
            close()
            if tag in VOID:
                continue
            same = ["p"] if tag in CLOSES_P else SIBLINGS[tag].split() if tag in SIBLINGS else []
            if same and (k := opened.nearest(same)):
                opened.pop_to(k)
            opened.push(tag, " ".join(a or b or c for _, a, b, c in NAMES.findall(attributes)) if attributes else "")
    rest = page[at:]
    cut = re.search(r"<(?=[a-zA-Z/!])[^<>]*\Z", rest)  # a tag that the page's end cuts off
    if rest := rest[: cut.start()] if cut else rest:
        parts.append(rest)
        linked += len(rest) if opened.links else 0
    close()
    return out


@lru_cache(1 << 14)
def _around_features(own: str, around: frozenset[int]) -> tuple[int, ...]:
    return tuple(sorted({_bucket("bias"), _bucket(f"own={own}")} | around))


def _text_features(block: Block) -> tuple[int, ...]:
    text, size = block.text, len(block.text)
    stops = text.count(".") + text.count("!") + text.count("?")
    found = (
        f"size={size.bit_length()}", f"stops={min(stops, 4)}", f"linked={min(4, 4 * block.linked // max(1, size))}",
        f"ends={text[-1] in '.!?…\"'}", f"copy={chr(169) in text}", f"commas={min(text.count(','), 3)}", f"digits={DIGIT.search(text) is not None}",
    )
    return tuple({_bucket(f) for f in found})


def features(blocks: list[Block]) -> list[tuple[int, ...]]:
    return [_around_features(b.own, b.around) + _text_features(b) for b in blocks]


@dataclass
class Chain:
    """weights: of each feature for the label text, against other; step: of each pair of labels; first: of the first label."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        w = self.weights
        scores = [float(w[list(f)].sum()) for f in features(blocks)]
        (oo, ot), (to, tt) = self.step.tolist()
        other, text = self.first[0], self.first[1] + scores[0]
        back: list[tuple[bool, bool]] = []
        for s in scores[1:]:
            from_text = (text + to > other + oo, text + tt > other + ot)
            back.append(from_text)
            other, text = max(text + to, other + oo), max(text + tt, other + ot) + s
        label = bool(text > other)
        out = [label]
        for b in reversed(back):
            label = b[1] if label else b[0]
            out.append(label)
        return out[::-1]


FAMILIES = {"article": 0.34, "main": 0.1, "named": 0.22, "invented": 0.12, "div": 0.08, "role": 0.05, "bare": 0.05, "table": 0.04}


def labelled_pages(n: int = 600, seed: int = 7, families: dict[str, float] = FAMILIES) -> list[tuple[str, list[bool]]]:
    """Labelled pages, made from a rule: around an article stand menus, headers, adverts, notices, sidebars, forms,
    comments and footers, by HTML5 tags or by divs with such names, each present or not; the label is whether a block
    is the article's. Texts are invented words, long and short on both sides, so that no word tells the label. One
    article in three stands in a container whose name tells nothing or which has none, or in no container, and so do
    some menus, so that texts and their links count where names fail; ``families`` chooses among the articles' containers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "ti", "es", "la", "de", "um", "qu", "oi")) for _ in range(rng.randint(1, 4)))

    def sentence(low: int, high: int) -> str:
        out = " ".join(word() for _ in range(rng.randint(low, high))).capitalize()
        return (out.replace(" ", ", ", 1) if rng.random() < 0.3 else out) + rng.choice((".", ".", ".", "", "!", "?"))

    prose = lambda: " ".join(sentence(4, 18) for _ in range(rng.randint(1, 6)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))

    def boxed(tag: str, names: tuple[str, ...], inner: str, count: int) -> tuple[str, list[bool]]:
        """By the tag, or a div with one of the names."""
        attribute = rng.choice(("class", "class", "id"))
        if tag == "nav" and rng.random() < 0.15:  # nothing but its links tells a menu
            begin, end = rng.choice(((f'<div {attribute}="{word()}">', "</div>"), ("<table><tr><td>", "</td></tr></table>")))
            return begin + inner + end, [False] * count
        if tag and rng.random() < 0.5:
            open_ = f"<{tag}>" if rng.random() < 0.6 else f'<{tag} {attribute}="{rng.choice(names)}">'
        else:
            tag = rng.choice(("div", "div", "section"))
            open_ = f'<{tag} {attribute}="{rng.choice(names)}">'
        return open_ + inner + f"</{tag}>", [False] * count

    def menu() -> tuple[str, list[bool]]:
        n = rng.randint(2, 8)
        return boxed("nav", ("nav", "menu", "navbar", "breadcrumb", "main-menu", "toc", "pagination"), f"<ul>{links(n)}</ul>", n)

    def header() -> tuple[str, list[bool]]:
        return boxed("header", ("header", "site-header", "masthead", "banner", "top-bar"), rng.choice((f"<p>{sentence(1, 6)}</p>", f"<h2>{sentence(1, 5)}</h2>", f"<div>{prose()}</div>")), 1)

    def footer() -> tuple[str, list[bool]]:
        return boxed("footer", ("footer", "site-footer", "copyright", "legal", "bottom"), rng.choice(("&copy; ", "", "")) + rng.choice((sentence(2, 12), prose(), f"<p>{prose()}</p>")), 1)

    def plain(names: tuple[str, ...], tag: str = "") -> tuple[str, list[bool]]:
        n = rng.randint(1, 3)
        inner = prose() if n == 1 else "".join(f"<p>{prose() if rng.random() < 0.6 else sentence(1, 6)}</p>" for _ in range(n))
        return boxed(tag, names, inner, n)

    advert = partial(plain, ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad"))
    notice = partial(plain, ("notice", "cookie", "cookie-notice", "consent", "alert", "newsletter", "popup", "subscribe", "paywall", "gdpr", "modal", "disclaimer"))
    sidebar = partial(plain, ("sidebar", "side", "related", "widget", "share", "social", "recommended", "trending", "rail"), "aside")

    def form() -> tuple[str, list[bool]]:
        return f'<form action="/{word()}"><label>{sentence(1, 5)}</label><input name="q"><button>{word()}</button></form>', [False, False]

    def comments() -> tuple[str, list[bool]]:
        n = rng.randint(1, 4)
        items = "".join(rng.choice((f"<p>{prose()}</p>", f'<div class="comment">{prose()}</div>', f"<li>{prose()}</li>")) for _ in range(n))
        head = rng.random() < 0.5
        return boxed("", ("comments", "comment-list", "comment", "responses", "discussion", "replies", "reviews", "disqus_thread"), (f"<h3>{sentence(1, 3)}</h3>" if head else "") + items, n + head)

    def article() -> tuple[str, list[bool]]:
        inner, labels = "", []
        for k in range(rng.choice((1, 2, 3, 5, 8, 14))):
            text = prose() if rng.random() < 0.8 else sentence(1, 4)
            kind = rng.random()
            if k == 0 and rng.random() < 0.8:
                inner, labels = inner + f"<h1>{sentence(1, 9)}</h1>", [*labels, True]
            if kind < 0.1:
                inner += rng.choice(("<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<pre>{}</pre>")).format(text)
            elif kind < 0.2:
                inner += f"<p><b>{text}<br>"
            elif kind < 0.3:
                inner += f'<p>{text} <a href="/{word()}">{word()}</a></p>'
            elif kind < 0.4:
                inner += f"<ul><li>{text}</li><li>{prose()}</li></ul>"
                labels.append(True)
            elif kind < 0.45:
                inner += f"<table><tr><td>{text}</td><td>{word()}</td></tr></table>"
                labels.append(True)
            else:
                inner += f"<p>{text}</p>"
            labels.append(True)
            if rng.random() < 0.08:
                more, other = rng.choice((advert, notice, sidebar, form))()
                inner, labels = inner + more, labels + other
        family = rng.choices(list(families), list(families.values()))[0]
        name = rng.choice(("article", "content", "post", "entry-content", "story", "main-content", "article-body", "text", "body-text"))
        attribute = rng.choice(("class", "id"))
        around = {
            "article": "<article>{}</article>", "main": "<main>{}</main>", "named": f'<div {attribute}="{name}">{{}}</div>', "invented": f'<div {attribute}="{word()}"><div class="{word()}">{{}}</div></div>',
            "div": "<div>{}</div>", "role": '<div role="main">{}</div>', "bare": "{}",
            "table": "<table><tr><td>{}</td></tr></table>",
        }
        before, after = around[family].split("{}")
        return before + inner + after, labels

    out = []
    while len(out) < n:
        page, labels = "", []
        before = [f for f, p in ((header, 0.5), (menu, 0.7), (notice, 0.3), (advert, 0.5), (form, 0.15)) if rng.random() < p]
        after = [f for f, p in ((comments, 0.4), (sidebar, 0.4), (advert, 0.2), (form, 0.15), (notice, 0.2), (menu, 0.15), (footer, 0.8)) if rng.random() < p]
        rng.shuffle(before)
        inside = rng.random() < 0.2
        for part in [*before, article, *after]:
            html_part, own = part()
            if inside and part is comments and page.endswith("</article>"):
                page = page.removesuffix("</article>") + html_part + "</article>"
            else:
                page += html_part
            labels += own
        page = f"<html><head><title>{word()}</title></head><body>{page}"
        if len(leaf_blocks(page)) == len(labels):  # a rule of nesting may join or split blocks; such a page is left out
            out.append((page, labels))
    return out


@lru_cache(1)
def train(pages: int = 600, steps: int = 200, rate: float = 0.1, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood on the labelled pages by full-batch steps (Adam); the gradient comes from forward-backward
    over all pages at once, padded to the longest. The pages are few whatever the corpus."""
    data = labelled_pages(pages)
    n, longest = len(data), max(len(y) for _, y in data)
    y = np.zeros((n, longest), int)
    inside = np.zeros((n, longest), bool)
    place, bucket = [], []
    for i, (page, labels) in enumerate(data):
        y[i, : len(labels)], inside[i, : len(labels)] = labels, True
        for t, f in enumerate(features(leaf_blocks(page))):
            place += [i * longest + t] * len(f)
            bucket += f
    place, bucket = np.array(place), np.array(bucket)
    width = 1 << BITS
    params = np.zeros(width + 6)
    m, v = np.zeros_like(params), np.zeros_like(params)
    pair_seen = np.zeros((2, 2))
    np.add.at(pair_seen, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
    first_seen = np.bincount(y[:, 0], minlength=2)
    weight_seen = np.bincount(bucket, y.ravel()[place], minlength=width)
    for k in range(1, steps + 1):
        step, first = params[width : width + 4].reshape(2, 2), params[width + 4 :]
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = np.bincount(place, params[:width][bucket], minlength=n * longest).reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + emit[:, t]
            ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            onward = behind[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(onward[:, :1] + step[:, 0], onward[:, 1:] + step[:, 1])
            behind[:, t] = np.where(inside[:, t + 1, None], new, behind[:, t + 1])
        chance = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * inside
        pair = np.exp(ahead[:, :-1, :, None] + step + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        grad = np.concatenate(
            [
                np.bincount(bucket, chance.ravel()[place], minlength=width) - weight_seen,
                (pair.sum((0, 1)) - pair_seen).ravel(),
                np.array([(1 - chance[:, 0]).sum(), chance[:, 0].sum()]) - first_seen,
            ]
        )
        grad = grad / n + penalty * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(params[:width], params[width : width + 4].reshape(2, 2), params[width + 4 :])


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, chain.decode(blocks), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html", 4 << 20):
            texts = [main_text(page, chain) for page in pc.fill_null(part.column("html"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text's blocks, one line each) and n_chars (code points) of every row.

    White space inside a block becomes one space and is trimmed at its ends; character references are decoded; a
    ``br`` is white space. Null or empty html, and pages without text blocks, have an empty text. Nothing is capped; time
    follows a page's length, however broken its markup. An unclosed tag without any > after it is text, up to the last
    one of a page, which the page's end cuts off; a tag with an unclosed quote ends at its first >. No pages, no rows.
    Rows are judged alone: repeated rows repeat, null ids and urls stay null; other columns aren't carried.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    out = pages.mapInArrow(partial(_extract, chain=train()), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
