import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from promptloom.llm import pages
from promptloom.llm.queries import QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.001"


class _Reader(HTMLParser):
    """Blocks of the article element, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks.append("") if tag in ("p", "h1", "article") else None

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article_of(page):
    reader = _Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(b for b in (" ".join(x.split()) for x in reader.blocks) if b)


@pytest.fixture(scope="module")
def weights(spark):
    return pages.train(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


def test_query_agrees_with_the_article_element(spark):
    given = {r["page_id"]: (r["url"], article_of(r["html"])) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op13_main_text"](spark, SF_DIR).collect()}
    assert found == {k: (url, text, len(text)) for k, (url, text) in given.items()}


def test_what_is_no_main_text_goes(weights):
    one, two, three = (cases.prose(k, 30) for k in range(3))
    page = f"""<!doctype html><HTML><head><title>a title of a page</title><style>p > a {{}}</style></head>
    <body class="no-sidebar"><header><h2>The name of this site</h2><p>{cases.prose(9, 12)}</p></header>
    <div class='cookie-notice'><p>{cases.prose(10, 14)}</p><form><p>words in a form</p></form></div>
    <ul id=mainMenu><li>menu</li><li><a href="/x">another entry of it</a></li></ul>
    <div class="content"><h1>A&nbsp;head &lt;line&gt;</h1><p>{one}</p>
    <div class="ad ad-wide"><p>{cases.prose(11, 8)}</p></div><script>if (a < b) document.write("<p>no words</p>")</script>
    <p>{two[:20]}<b>{two[20:40]}</b>{two[40:]}</p><!-- <p>a comment</p> --><aside><p>{cases.prose(12, 9)}</p></aside>
    <p>{three}<br>caf&eacute; &#x41;&#66;</p></div>
    <section id="comments"><article class="comment"><p>{cases.prose(13, 25)}</p></article></section>
    <div class="sidebar"><p>{cases.prose(14, 12)}</p></div><footer><p>{cases.prose(15, 12)}</p></footer></body></html>"""
    expected = f"A head <line>\n{one}\n{two}\n{three} café AB"
    assert pages.main_text(page, weights) == expected
    marked = page.replace('<div class="content">', "<article><header><p>by someone</p>").replace("</h1>", "</h1></header>").replace("</p></div>\n    <section", "</p></article>\n    <section")
    assert marked.count("<article>") == 1
    assert pages.main_text(marked, weights) == expected


def test_elements_that_never_end_do_not_swallow_the_article(weights):
    text = cases.prose(3, 40)
    for opening in ("<div class=ad>", "<nav><ul><li>x", "<form>", "<p class=promo>one two", "<b><i>"):
        assert pages.main_text(f"<body>{opening}<article><p>{text}</p></article>", weights) == text
    for cut in ("<p", "<p class='x", "</p", "<!-- x", "<script>x", "<"):
        assert pages.main_text(f"<article><p>{text}</p>{cut}", weights).rstrip("\n<") == text


def test_best_region_agrees_with_all_regions(weights):
    draw = random.Random(5)
    parts = ["<p>", "</p>", "<div>", "</div>", "<h1>", "</h1>", "<li>", "</a>", "<a href=x>", "one two ", "three ", "<article>", "four five six ", "<br>"]
    for _ in range(200):
        page = "".join(draw.choice(parts) for _ in range(25))
        tokens = pages._kept(pages._tokens(page))
        scores = [weights.of(kind, words) if words else 0.0 for kind, words in pages._kinds(tokens)]
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0.0)
        whole = pages.main_text(page, weights)
        if best <= 0:
            assert whole == ""
        elif whole:
            words = [t.text.split() for t in tokens if t.name is None]
            flat = [w for part in words for w in part]
            assert " ".join(whole.split()) in " ".join(flat) or "br" in page


def test_long_pages_take_time_in_proportion(weights):
    start = time.perf_counter()
    for part in ('<a "', "<!--", "<p", '<div class="ad">', "<script>", "<x y='", "</p>", "<header>", "<nav>x", "&amp;", "a ", "<article>", "<p>a b </p>"):
        pages.main_text(part * 20_000, weights)
    assert time.perf_counter() - start < 20


def test_awkward_rows(spark, weights):
    text = cases.prose(1, 30)
    rows = [
        (1, "u", f"<article><p>{text}</p></article>", "x", 5),
        (1, "u", f"<article><p>{text}</p></article>", "x", 5),
        (2, None, None, None, None),
        (None, "v", "", "y", 1),
        (3, "v", "<p></p><div>", "y", 1),
        (4, "v", text, "y", 1),
        (5, "v", f"<main><p>{cases.prose(2, 60_000)}</p></main>", "y", 1),
    ]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = pages.extract_text(given, weights)
    assert found.columns == ["page_id", "url", "html", "text", "n_chars"]
    texts = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in found.collect())
    long = cases.prose(2, 60_000)
    assert texts == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, text, len(text)), (5, long, len(long))]
    none = given.where(F.lit(False))
    assert pages.extract_text(none, pages.train(none)).count() == 0
    unlabelled = pages.train(given.where("page_id = 4"))
    assert {r["text"] for r in pages.extract_text(given.where("page_id = 1"), unlabelled).collect()} == {text}
