"""Main text of web pages: the contiguous region with the largest sum of scores.

A page is read as a sequence of tags and texts. Words score positive, tags negative, and one
linear scan finds the run of tokens with the largest sum, which is the main text.

Elements that hold no main text by their kind are cut out before the scan and stand as one
negative token each: scripts, styles, forms, menus, headers, footers, sidebars, and elements
whose class, id or role names an advert, a notice, a menu, reader comments and so on
(``_CUT_TAGS``, ``_CUT_NAMES``). An element that holds the article itself is never cut.

Weights come from labelled pages: pages whose own markup names the article (``article`` or
``main``). A word's weight is the share of words of its kind, by enclosing block and whether it
is in a link, that stand inside the article. A tag's weight is the log odds of its standing
inside, and below zero. No weight knows of the ``article`` element as such, so the scan also
works on pages without one. The sample is drawn by a hash of the page at a rate that gives about
``LABELLED`` pages; only the counts of the ``MOST_KINDS`` most frequent kinds go to the driver.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.llm.common import add_columns, table
from promptloom.llm.registry import query
from promptloom.session import ship_package

LABELLED = 2000
MOST_KINDS = 1000

# Raw elements and comments are one token, tags another; a quoted value may hold any character.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|select|title)(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/][^<>]*>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/!?][^<>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset(("article", "main"))
_CUT_TAGS = frozenset("aside button dialog fieldset footer form header menu nav".split())
_CUT_NAMES = frozenset(
    "ad ads adsense adslot advert advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment "
    "commentary comments complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus footer "
    "form gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination paywall popup promo promoted promotion recommended related replies respond search "
    "share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
_CUT = "!cut"


def _names_cut(rest: str) -> bool:
    """Whether the attributes of a tag say that it holds no main text."""
    if not rest or rest.isspace():
        return False
    for name, one, two, three in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name == "hidden":
            return True
        if name in ("class", "id", "role") and any(w.lower() in _CUT_NAMES for w in _NAME.findall(one or two or three)):
            return True
        if name == "style" and "display:none" in (one or two or three).replace(" ", "").lower():
            return True
    return False


@dataclass
class _Token:
    name: str | None  # a tag's name, None for text
    text: str = ""
    end: bool = False
    cut: bool = False  # opens an element that is cut out, if it does not hold the article
    match: int = -1  # the token that closes this element
    heads: bool = False  # in a header of an article: only its headings are read


def _tokens(page: str) -> list[_Token]:
    """Tags and texts of a page; raw elements, comments and declarations are left out."""
    found: list[_Token] = []
    opened: dict[str, list[int]] = {}
    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            found.append(_Token(None, text))
        elif (tag := token["tag"]) is not None:
            name, rest = tag.lower(), token["rest"]
            if token["end"]:
                if stack := opened.get(name):
                    found[stack.pop()].match = len(found)
                found.append(_Token(name, end=True))
            else:
                cut = name in _CUT_TAGS or name not in ("html", "body") and _names_cut(rest)
                if name not in _VOID and not rest.endswith("/"):
                    opened.setdefault(name, []).append(len(found))
                found.append(_Token(name, cut=cut))
    return found


def _kept(tokens: list[_Token]) -> list[_Token]:
    """The tokens with one ``!cut`` for each element that is cut out."""
    articles = [i for i, t in enumerate(tokens) if t.name in _ARTICLE and not t.end and not t.cut]
    headlines = [i for i, t in enumerate(tokens) if t.name == "h1" and not t.end]
    kept: list[_Token] = []
    at, article, depth, head = 0, 0, 0, -1
    while at < len(tokens):
        token = tokens[at]
        while article < len(articles) and articles[article] <= at:
            article += 1
        if token.name in _ARTICLE:
            depth = max(0, depth - 1) if token.end else depth + 1
        if not token.cut or token.end:
            token.heads = at < head
            kept.append(token)
            at += 1
            continue
        following = articles[article] if article < len(articles) else len(tokens)
        stop = token.match
        if stop < 0:  # never closed: up to the article, a headline, or not at all
            next_one = bisect_left(headlines, at)
            stop = min(following, headlines[next_one] if next_one < len(headlines) else following) - 1
            stop = stop if stop + 1 < len(tokens) else at
        elif stop > following and token.name not in ("nav", "aside", "footer"):
            kept.append(token)  # holds the article
            at += 1
            continue
        elif token.name == "header" and depth:
            head = max(head, stop)
            kept.append(token)
            at += 1
            continue
        kept.append(_Token(_CUT))
        at = stop + 1
    return kept


def _kinds(tokens: list[_Token]) -> Iterator[tuple[str, int]]:
    """Each token's kind and its number of words (-1 for a tag)."""
    blocks: list[str] = []
    held: Counter = Counter()
    link = False
    for token in tokens:
        name = token.name
        if name is None:
            words = 0 if token.heads and not (blocks and blocks[-1] in _HEADINGS) else len(token.text.split())
            yield f"{blocks[-1] if blocks else ''}{' a' if link else ''}", words
            continue
        if name == "a":
            link = not token.end
        elif name not in _INLINE and name != _CUT and name not in _VOID:
            link = False
            if not token.end:
                if name == "p" and blocks and blocks[-1] == "p":
                    blocks.pop()
                    held["p"] -= 1
                blocks.append(name)
                held[name] += 1
            elif held[name]:
                while (last := blocks.pop()) != name:
                    held[last] -= 1
                held[name] -= 1
        yield f"/{name}" if token.end else name, -1


@dataclass
class Weights:
    """What a word (by its kind) and a tag (by its name) score."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, kind: str, words: int) -> float:
        return self.tags.get(kind, -1.0) if words < 0 else words * self.words.get(kind, 0.5)


def fit(counts: dict[tuple[bool, str, bool], int]) -> Weights:
    """Weights from numbers of tokens by (is a word, kind, inside the article)."""
    weights = Weights()
    for is_word, kind in {(w, k) for w, k, _ in counts}:
        inside, outside = counts.get((is_word, kind, True), 0), counts.get((is_word, kind, False), 0)
        if is_word:
            weights.words[kind] = (inside + 0.5) / (inside + outside + 1)
        else:
            weights.tags[kind] = min(-0.05, math.log((inside + 1) / (outside + 3)))
    return weights


def label_counts(page: str) -> Counter:
    """Numbers of tokens inside and outside the page's article; none if no markup names one."""
    tokens = _kept(_tokens(page))
    first = next((i for i, t in enumerate(tokens) if t.name in _ARTICLE and not t.end and not t.cut), None)
    counts: Counter = Counter()
    if first is None:
        return counts
    depth, last = 0, len(tokens)
    for at in range(first, len(tokens)):
        if tokens[at].name == tokens[first].name:
            depth += -1 if tokens[at].end else 1
            if not depth:
                last = at
                break
    for at, (kind, words) in enumerate(_kinds(tokens)):
        if words:
            counts[words > 0, kind, first < at < last] += max(1, words)
    return counts


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region, joined by line feeds; white space in a block is one blank."""
    if not page:
        return ""
    tokens = _kept(_tokens(page))
    kinds = list(_kinds(tokens))
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for at, (kind, words) in enumerate(kinds):
        if total <= 0:
            total, start = 0.0, at
        if words:
            total += weights.of(kind, words)
        if total > best:
            best, region = total, (start, at + 1)
    # A region needs a word of which more stand inside articles than outside.
    if not any(words > 0 and weights.words.get(kind, 0.5) >= 0.5 for kind, words in kinds[slice(*region)]):
        return ""
    blocks, part = [], []
    for at in range(*region):
        token = tokens[at]
        if token.name is None:
            if kinds[at][1] or not token.heads:
                part.append(token.text)
        elif token.name == "br":
            part.append(" ")
        elif token.name not in _INLINE:
            blocks.append("".join(part))
            part = []
    blocks.append("".join(part))
    return "\n".join(text for text in (" ".join(html.unescape(block).split()) for block in blocks) if text)


def train(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from about ``LABELLED`` pages of ``pages``; without labelled ones those of no counts."""
    ship_package(pages.sparkSession)
    text = F.col(f"`{html_col}`").cast("binary")
    rate = min(1.0, LABELLED / max(1, pages.count()))
    drawn = pages.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(rate * 1_000_000)).select(text.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0):
                counts.update(label_counts(_decoded(page.as_py())))
            rows = [(*key, n) for key, n in counts.items()]
            columns = zip(*rows) if rows else [[]] * 4
            types = (pa.bool_(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "kind", "inside", "n"])

    counts = drawn.mapInArrow(run, "word boolean, kind string, inside boolean, n long").groupBy("word", "kind", "inside").agg(F.sum("n").alias("n"))
    often = counts.orderBy(F.desc("n"), "word", "kind", "inside").limit(MOST_KINDS)
    return fit({(r["word"], r["kind"], r["inside"]): r["n"] for r in often.collect()})


def _decoded(page: bytes | None) -> str:
    return (page or b"").decode("utf-8", "replace")


def extract_text(pages: DataFrame, weights: Weights, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points); columns of these names are replaced.

    A null or empty page, one of tags only and one without a region have an empty text. Pages
    of any length are read whole, in time in proportion to their length; a tag, comment or
    element that is not closed ends with the page, or where the article begins. Repeated rows
    and null ids stay as they are; an empty table gives an empty result.
    """
    fields = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> list:
            texts = [main_text(_decoded(page.as_py()), own) for page in batch.column(0)]
            return [texts, [len(t) for t in texts]]

        return step

    return add_columns(pages, [F.col(f"`{html_col}`").cast("binary")], fields, make)


@query()
def op13_main_text(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train(pages)).select("page_id", "url", "text", "n_chars")
