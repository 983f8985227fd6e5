import html
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import htmltext
from tallyworks.llm.common import read_table


@pytest.fixture(scope="module")
def tree(spark):
    return htmltext.train(spark)


def article(source):
    """The text of the article element of a given page, by plain splitting."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", inner))
    return "\n".join(p for p in parts if p)


def test_given_pages(spark, sf_dir):
    source = {r.page_id: r.html for r in read_table(spark, sf_dir, "pages").collect()}
    got = htmltext.op12_main_text(spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == {k: article(h) for k, h in source.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts(tree):
    """On labelled pages that the tree has not seen: nothing wrong where markup tells, few words missed where there is none."""
    right = {True: [0, 0, 0], False: [0, 0, 0]}
    for k, (source, kept) in enumerate(htmltext.labelled_pages(160, seed=11)):
        text, _, _ = htmltext.main_text(tree, source)
        got, want, score = set(text.split("\n")) - {""}, set(kept), right[k % 4 != 2]
        for i, x in enumerate((len(got & want), len(got), len(want))):
            score[i] += x
    for named, least in ((True, 0.98), (False, 0.9)):
        both, got, want = right[named]
        assert both / got >= least and both / want >= least


PAGE = """<body><div id="cookieConsent">We use cookies. Accept all of them now please.</div><header class=site><a href=/>Home page</a></header>
<div class="content-sidebar-wrap has-footer"><div class="post-content"><div class="entry-header"><h2>A title</h2></div><p>One   paragraph with <a href="x">a link</a>, &eacute;t&#233; &amp; more,<br>that goes on over several lines and words.<p>Unclosed &lt;b&gt; second paragraph <b>of some words</p>
<script>if (a < b) document.write("<p>no</p>")</script><style>p { }</style><!-- <p>no</p> --><ul><li>First item of the list in here<li>Second item of the list in here</ul></div></div>
<section id="comments"><h3>2 comments</h3><article><p>I think that this is quite a long comment by a reader, of many words, about everything.</p></article></section>
<form action=/><p>Type your mail here to get all of our news</p><button>Send</button></form><div style="display: none">hidden words of this page</div><footer>&copy; 2024 Somebody</footer>"""


def test_a_page_of_another_kind(tree):
    text, n, kept = htmltext.main_text(tree, PAGE)
    assert text.split("\n") == ["A title", "One paragraph with a link, été & more, that goes on over several lines and words.", "Unclosed <b> second paragraph of some words", "First item of the list in here", "Second item of the list in here"]
    assert n > kept == 5


def test_awkward_pages(spark, tree):
    rows = [(1, None), (2, ""), (3, "plain words without any markup, but enough of them to be read as a text"), (4, "<p>a < b and c <3 d</p>"), (5, "<p title='>'>x</p"), (6, "\0<p>퟿</p>"), (7, "<article><p>" + "word " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit(c) for c in ("text", "n_kept", "a.b", "n_blocks")})
    got = {r.page_id: r for r in htmltext.extract(df, tree=tree).collect()}
    assert len(got) == 7 and got[1].text == got[2].text == "" and got[1].n_chars == 0 and got[7].n_chars == 5 * 200_000 - 1
    assert got[1]["a.b"] == "a.b" and got[1].html is None
    assert htmltext.extract(df.limit(0), tree=tree).count() == 0


@pytest.mark.parametrize("piece", ["<a \"'>", "<", "<p", "<div>", "<a ='", "&amp", "<!--", "<script>", "<div hidden>", "<div hidden></div>", "<div hidden><div ", "<li><p>", "<p><b>", "</div>"])
def test_linear_time(piece):
    begun = time.perf_counter()
    htmltext.blocks(piece * 20_000)
    assert time.perf_counter() - begun < 10


def test_notices_are_seen_by_their_parts(monkeypatch):
    """Every kind of notice, in any case, with letters that only patterns take for others; texts without a part aren't searched."""
    kinds = [
        "© 2020", "(C) 1999", "all RIGHTS reserved", "Cookies: please accept", "a cookie policy", "we use cookies", "this website uses cookies", "Privacy Policy", "terms of use", "subscribe today", "Sign up for it",
        "newsletter", "advertisement", "Advertising", "sponsored", "Alle Rechte vorbehalten", "Datenschutzerklärung", "tous droits RÉSERVÉS", "todos los derechos", "terms of art", "cookie", "advertising men", "prose", "",
    ]
    swaps = [str, str.upper, str.title, lambda t: t.replace("s", "ſ"), lambda t: t.replace("i", "ı"), lambda t: t.replace("i", "İ"), lambda t: t.replace("k", "K"), lambda t: f"Größe {t} und {t} mehr"]
    for t in kinds:
        for swap in swaps:
            assert htmltext.is_notice(swap(t)) == bool(htmltext.NOTICE.search(swap(t))), swap(t)

    class Searched:
        def search(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(htmltext, "NOTICE", Searched())
    assert not htmltext.is_notice("A long article about Größen and other things. " * 100)


def test_pages_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "PART", 300)
    texts = [None, "", *("<p>" + f"Word number {k} of a page that is read as a whole. " * (k % 9) for k in range(60))]
    pages = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "page_id long, html string").coalesce(1)
    tree = [(-1, 1.0, 0, 0)]
    got = {r.page_id: (r.html, r.text, r.n_blocks, r.n_kept, r.n_chars) for r in htmltext.extract(pages, tree=tree).collect()}
    assert got == {k: (t, *htmltext.main_text(tree, t), len(htmltext.main_text(tree, t)[0])) for k, t in enumerate(texts)}
