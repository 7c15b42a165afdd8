"""Main text of web pages: a linear-chain conditional random field over the blocks of the page."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Tags that don't end a block (those of formulas and drawings too), tags without content, tags whose content is no text: scripts, styles and what is
#: typed into a form. Fixed values of HTML.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot semantics annotation svg g tspan object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea".split())
#: Which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("html body table ul ol dl select article section div nav aside main header footer form blockquote".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Ancestor tags and words of class, id and role that are features.
TAGS = tuple("article main section header footer nav aside form head title figure figcaption table ul ol li dl p h1 h2 h3 h4 blockquote pre div body button select fieldset dialog address menu td".split())
WORDS = tuple(
    "ad ads advert advertisement advertising sponsor sponsored promo banner popup modal cookie cookies consent notice alert message newsletter subscribe signup login search menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar widget related recommended share social tags meta byline author footer header masthead copyright legal comment comments reply replies disqus discussion responses respond "
    "pagination pager toc content contents article post entry story body main text page complementary contentinfo".split()
)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _marks(attributes: str) -> str:
    """Words of class, id and role that are features."""
    found = " ".join(x for m in NAME.findall(attributes) for x in m if x) if "=" in attributes else ""
    return "".join(f".{w}" for w in sorted(set(re.split(r"[^a-z]+", found.lower()))) if w in WORDS) if found else ""


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in its order: text between the tags of block elements, with the path of open
    elements there (innermost last). Comments, declarations, scripts and styles are no text. Character
    references are decoded and white space becomes one space. Unclosed elements end where HTML says."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    path: tuple[str, ...] = ()
    text: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(path, joined, linked))
            text.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal in_link
        in_link -= sum(1 for t, _ in stack[to:] if t == "a")
        del stack[to:]

    def last(names: frozenset[str] | set[str], fence: frozenset[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in fence:
                return -1
        return -1

    at, end = 0, len(page)
    while at < end:
        stop = page.find("<", at)
        m = TAG.match(page, stop) if stop >= 0 else None
        stop = end if stop < 0 else stop if m else stop + 1
        if stop > at:
            text.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            at = stop
            continue
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if attributes.endswith("/"):
                continue
            e = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if e or tag != "textarea":  # a script or style without an end goes on to the end of the page
                at = e.end() if e else end
                continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                text.append(" " if tag == "br" else "")
            elif not closing:
                stack.append((tag, ""))
                in_link += tag == "a"
            elif (i := last({tag}, FENCE)) >= 0:
                close(i)
            continue
        flush()
        if not closing:
            ends = ENDS.get(tag, set()) | {"p"}
            while (i := last(ends, FENCE)) >= 0:
                close(i)
            if tag not in VOID and not attributes.endswith("/"):
                stack.append((tag, _marks(attributes)))
        elif (i := last({tag}, frozenset())) >= 0:
            close(i)
        path = tuple(t + w for t, w in stack if t not in INLINE)
    flush()
    return out


BIAS = ("bias",)
TEXT = ("words<4", "words<10", "words<25", "words>=25", "linked>0.8", "linked>0.3", "linked", "ends a sentence", "has commas", "copyright", "few letters", "first", "last", "inner p", "inner li", "inner h", "inner div", "no path")
FEATURES = {f: i for i, f in enumerate((*BIAS, *TEXT, *(f"<{t}>" for t in TAGS), *(f".{w}" for w in WORDS)))}


def path_features(path: tuple[str, ...]) -> list[int]:
    names: set[str] = set()
    for step in path:
        tag, *words = step.split(".")
        names.add(f"<{tag}>")
        names.update(f".{w}" for w in words)
    inner = path[-1].split(".")[0] if path else ""
    names.add("inner p" if inner == "p" else "inner li" if inner == "li" else "inner h" if re.fullmatch("h[1-6]", inner) else "inner div" if inner == "div" else "no path" if not inner else "")
    return [FEATURES[n] for n in names if n in FEATURES]


def text_features(b: Block, nth: int, count: int) -> list[int]:
    n = b.text.count(" ") + 1
    share = b.linked / max(1, len(b.text))
    names = ["bias", "words<4" if n < 4 else "words<10" if n < 10 else "words<25" if n < 25 else "words>=25"]
    if share > 0:
        names.append("linked>0.8" if share > 0.8 else "linked>0.3" if share > 0.3 else "linked")
    if b.text.rstrip("\"')”» ")[-1:] in (".", "!", "?", "…"):
        names.append("ends a sentence")
    if ", " in b.text:
        names.append("has commas")
    if "©" in b.text[:40]:
        names.append("copyright")
    if n < 10 and sum(map(str.isalpha, b.text)) < len(b.text) / 2:
        names.append("few letters")
    names += ["first"] * (nth == 0) + ["last"] * (nth == count - 1)
    return [FEATURES[x] for x in names]


class Field:
    """Labels 0 (other) and 1 (main text) of a page's blocks in their order."""

    def __init__(self) -> None:
        self.weight = np.zeros((len(FEATURES), 2))
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)
        self._paths: dict[tuple[str, ...], list[int]] = {}

    def features(self, page: list[Block]) -> list[list[int]]:
        out = []
        for i, b in enumerate(page):
            if b.path not in self._paths:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                self._paths[b.path] = path_features(b.path)
            out.append(self._paths[b.path] + text_features(b, i, len(page)))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        own = getattr(self, "_own", None)
        if own is None:
            own = self._own = (self.weight[:, 1] - self.weight[:, 0]).tolist(), self.step.tolist(), self.start.tolist()
        w, t, s = own
        back: list[tuple[int, int]] = []
        a, b = s
        for i, f in enumerate(self.features(page)):
            if i:
                from0 = 0 if a + t[0][0] >= b + t[1][0] else 1
                from1 = 0 if a + t[0][1] >= b + t[1][1] else 1
                back.append((from0, from1))
                a, b = max(a + t[0][0], b + t[1][0]), max(a + t[0][1], b + t[1][1])
            b += sum([w[x] for x in f])
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def _marginals(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(unary)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + unary[0]
        for i in range(1, n):
            ahead[i] = unary[i] + np.logaddexp(ahead[i - 1, 0] + self.step[0], ahead[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp(self.step[:, 0] + unary[i + 1, 0] + behind[i + 1, 0], self.step[:, 1] + unary[i + 1, 1] + behind[i + 1, 1])
        total = np.logaddexp(*ahead[-1])
        pairs = ahead[:-1, :, None] + self.step + (unary[1:] + behind[1:])[:, None, :] - total
        return np.exp(ahead + behind - total), np.exp(pairs)

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 10, rate: float = 0.3, penalty: float = 1e-3, seed: int = 3) -> Field:
        """Maximum conditional likelihood, by adaptive gradient steps a page."""
        rng = random.Random(seed)
        data = []
        for page, labels in pages:
            if page:
                x = np.zeros((len(page), len(FEATURES)))
                for i, f in enumerate(self.features(page)):
                    x[i, f] = 1
                data.append((x, np.eye(2)[labels]))
        squares = [np.full_like(p, 1e-2) for p in (self.weight, self.step, self.start)]
        for _ in range(epochs):
            rng.shuffle(data)
            for x, y in data:
                node, pair = self._marginals(x @ self.weight)
                want = np.einsum("ia,ib->ab", y[:-1], y[1:])
                grads = (x.T @ (y - node) - penalty * self.weight, want - pair.sum(axis=0), y[0] - node[0])
                for p, g, s in zip((self.weight, self.step, self.start), grads, squares, strict=True):
                    s += g * g
                    p += rate * g / np.sqrt(s)
        return self

    def text(self, page: str) -> str:
        """Main text of a page: its blocks labelled so, joined by one space."""
        found = blocks(page)
        return " ".join(b.text for b, label in zip(found, self.decode(found), strict=True) if label)


MAIN = "⁣"  # an invisible mark in the main text of labelled pages; taken out before they are used


def labelled_pages(n: int = 400, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Pages with known main text: drawn from the usual ways to lay out a page (with and without semantic
    tags, named or plain containers, every kind of furniture around and inside the article)."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkéñü"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(3, 14).capitalize() + r.choice([".", ".", ".", ", " + words(2, 8) + ".", "?", "!"])

    def sentences(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(r.randint(a, b)))

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def maybe(p: float, make) -> str:
        return make() if r.random() < p else ""

    def named(tag: str, *names: str) -> str:
        how = r.choice(["class", "class", "id"])
        return f'<{tag} {how}="{r.choice(names)}">'

    def links(a: int, b: int) -> str:
        items = [link(words(1, 3)) for _ in range(r.randint(a, b))]
        return r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def menu() -> str:
        return r.choice([f"<nav>{links(3, 8)}</nav>", named("div", "menu", "nav", "navbar", "navigation") + links(3, 8) + "</div>", f'<div role="navigation">{links(3, 8)}</div>'])

    def header() -> str:
        inside = maybe(0.5, lambda: f"<h1>{words(1, 3)}</h1>") + maybe(0.6, lambda: f"<p>{words(3, 8)}</p>") + maybe(0.5, menu)
        return r.choice([f"<header>{inside}</header>", named("div", "header", "masthead", "site-header") + inside + "</div>"])

    def footer() -> str:
        inside = r.choice([f"&copy; {word()}.com &middot; {sentence()}", f"<p>&copy; 2024 {words(2, 5)}. All rights reserved.</p>", links(2, 5), sentences(1, 3)]) + maybe(0.3, lambda: f"<p>{sentences(1, 2)}</p>")
        return r.choice([f"<footer>{inside}</footer>", f"<footer>{inside}</footer>", named("div", "footer", "site-footer", "copyright", "legal") + inside + "</div>"])

    def advert() -> str:
        return named(r.choice(["div", "div", "aside", "section", "p"]), "ad", "ads", "ad-box", "advert", "advertisement", "sponsored", "promo", "banner") + r.choice([sentence(), sentences(1, 3), words(3, 9), link(words(2, 5))]) + "</div>"

    def notice() -> str:
        return named("div", "cookie-notice", "notice", "consent", "newsletter", "popup", "alert", "subscribe") + f"<p>{sentences(1, 3)}</p>" + maybe(0.5, lambda: f"<button>{words(1, 2)}</button>") + "</div>"

    def aside() -> str:
        inside = f"<h3>{words(1, 3)}</h3>" + r.choice([links(3, 6), f"<p>{sentences(1, 4)}</p>", f"<p>{sentence()}</p>{links(2, 4)}"])
        return r.choice([f"<aside>{inside}</aside>", named("div", "sidebar", "widget", "related", "recommended") + inside + "</div>"])

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 4)}</label><input name="q"><p>{sentence()}</p><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>'

    def comments() -> str:
        one = lambda: r.choice([f'<div class="comment"><b>{word()}</b><p>{sentences(1, 4)}</p></div>', f'<li class="comment">{sentences(1, 3)}</li>', f"<article><h4>{word()}</h4><p>{sentences(1, 4)}</p></article>"])
        return named(r.choice(["section", "div", "ol"]), "comments", "comment-list", "discussion", "responses", "replies") + maybe(0.6, lambda: f"<h3>{words(1, 3)}</h3>") + "".join(one() for _ in range(r.randint(1, 5))) + "</div>"

    def main(text: str) -> str:
        return MAIN + text

    def paragraph() -> str:
        body = main(r.choice([sentences(1, 9)] * 5 + [words(1, 3), words(1, 3).upper() + "!!", words(1, 3) + ".", words(2, 8)]))
        body = maybe(0.2, lambda: "<b>") + body + maybe(0.15, lambda: f" {link(words(1, 3))} {sentence()}") + maybe(0.15, lambda: "<br>" + sentence())
        return r.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p>{body}</p>\n"])

    def article() -> str:
        kinds = [(12, paragraph), (1, lambda: f"<h2>{main(words(2, 7))}</h2>"), (1, lambda: f"<ul>{''.join(f'<li>{main(words(2, 12))}</li>' for _ in range(r.randint(2, 5)))}</ul>"), (1, lambda: f"<blockquote>{main(sentences(1, 3))}</blockquote>"), (1, lambda: f"<pre>{main(words(3, 20))}</pre>"), (0.7, lambda: f"<table><tr><td>{main(words(1, 4))}<td>{main(words(1, 4))}</table>"), (1.2, advert), (0.5, aside), (0.5, form), (0.4, notice)]
        inner = maybe(0.85, lambda: f"<h1>{main(words(2, 12))}</h1>")
        inner += "".join(r.choices([k for _, k in kinds], [w for w, _ in kinds])[0]() for _ in range(r.randint(1, 14)))
        tail = maybe(0.15, lambda: named("div", "share", "social", "tags") + links(2, 5) + "</div>") + maybe(0.12, comments)
        style = r.random()
        if style < 0.5:
            return f"<article>{inner}{tail}</article>"
        if style < 0.62:
            return f"<main>{inner}{tail}</main>"
        if style < 0.7:
            return inner
        if style < 0.92:
            return named("div", "content", "post", "entry-content", "article-body", "story", "main") + inner + tail + "</div>"
        return f"<div>{inner}{tail}</div>"

    out = []
    for _ in range(n):
        head = f"<head><title>{words(2, 9)}</title>{maybe(0.5, lambda: '<style>p{margin:0}</style>')}{maybe(0.5, lambda: '<script>var a=1;</script>')}</head>"
        top = "".join(maybe(p, k) for p, k in ((0.4, header), (0.7, menu), (0.25, notice), (0.5, advert), (0.2, form)))
        rest = "".join(maybe(p, k) for p, k in ((0.3, aside), (0.3, comments), (0.25, advert), (0.15, notice), (0.15, form), (0.15, menu), (0.85, footer)))
        page = blocks(f"<!DOCTYPE html><html>{head}<body>{top}{article()}{rest}" + maybe(0.8, lambda: "</body></html>"))
        out.append(([Block(b.path, b.text.replace(MAIN, ""), b.linked) for b in page], [int(MAIN in b.text) for b in page]))
    return out


def trained_field(n: int = 400, seed: int = 1) -> Field:
    return Field().train(labelled_pages(n, seed))


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Main text of ``pages`` (``page_id, url, html``): the blocks that a conditional random field, trained on
    labelled pages (``labelled_pages``), takes for the article, in page order.

    A null or empty page, and one without main text, gives an empty text. Cut-off pages and tags without
    end are read as far as they go. Rows with equal page_id are pages of their own; an empty table gives
    an empty result; other columns are not read. A page is read whole, whatever its length, by one call in one task: memory grows with the
    longest page and not with the table. Returns ``page_id, url, text, n_chars``.
    """
    spark = pages.sparkSession
    short_batches(spark)
    model = spark.sparkContext.broadcast(trained_field() if field is None else field)  # a few hundred weights

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.value.text(x) for x in batch.column("html").to_pylist()]
            lengths = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return whole.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
