"""Main text of web pages: flat text blocks, classified by a decision tree over the blocks and their neighbours.

A page becomes a flat list of text blocks; a block has its number of words and its link density, those of the blocks before and
after it, and what the markup around it tells (navigation, form, comment, names of classes). A decision tree, trained by Spark
on a small table of labelled blocks, says which blocks belong to the article. The tree is a few dozen numbers, so
pages are read where they are: one pass, no shuffle.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, read_table

#: Pages in the labelled table (about thirty blocks each) and the depth of the tree.
LABELLED_PAGES = 240
TREE_DEPTH = 10
#: Characters of pages after which their texts are handed on: they may be long.
PART = 1 << 20

# Elements by what they do to a text, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
FORM = frozenset("form button select option optgroup fieldset datalist input legend".split())
BOILER = frozenset(("nav", "footer", "aside", "menu", "dialog"))
#: Words in class and id names.
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner billboard breadcrumb breadcrumbs byline colophon cookie cookies consent copyright disclaimer disclosure footer footnav gdpr header hero login masthead menu meta modal nav navbar navigation navi newsletter "
    "notice notification overlay pager pagination pagenav popup privacy promo promoted promotion recommended related rail search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar toc "
    "topbar tracking trending warning widget widgets alert alerts announcement bottombar".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist discussion disqus replies reply respond responses review reviews reader readers feedback usercontent guestbook".split())
CONTENT_NAMES = frozenset("article articlebody body bodytext content contents copy entry entrycontent main maincontent post postbody postcontent story storybody text".split())
BESIDE, WRAPS = frozenset(("has", "with", "no")), frozenset(("wrap", "wrapper", "container", "layout"))
#: Headings after which other people's words or other pages follow.
CLOSING = re.compile(
    r"^\W*(\d+\s+)?(reader\s+)?(comments?|discussion|responses?|replies|leave a (comment|reply)|related( \w+)?|read (more|next|also)|more (from|stories|news|on)\b.*|you (may|might) also like.*|share( this)?.*|popular( \w+)?|trending|"
    r"kommentare?|diskussion|leserkommentare|mehr zum thema|commentaires?|à lire aussi|articles? (liés|similaires)|comentarios?|relacionad[oa]s?|artículos relacionados)\W*(\(\d+\))?\W*$",
    re.IGNORECASE,
)
#: What notices of all kinds say, wherever they stand.
NOTICE = re.compile(
    r"©|\(c\) ?\d{4}|\ball rights reserved|\bcookies?\b.{0,80}\b(accept|agree|consent|use|policy|preferences|settings)|\b(we|this (web)?site) uses? cookies|\bprivacy policy\b|\bterms of (use|service)\b|\bsubscribe (now|to|today)|\bsign up (for|to|now)|\bnewsletter\b|\badvertis(e|ing)ment\b|\bsponsored\b|"
    r"\balle rechte vorbehalten|\bdatenschutz|\btous droits réservés|\btodos los derechos",
    re.IGNORECASE,
)

#: A part of every notice, in small letters; and letters that a pattern takes for i and s, but lower() leaves as they are or makes two of.
NOTICE_PARTS = ("©", "(c)", "rights reserved", "cookie", "privacy policy", "terms of", "subscribe", "sign up", "newsletter", "advertis", "sponsored", "alle rechte", "datenschutz", "tous droits", "todos los")
_OTHER_CASES = "ſıİ"

# A tag by HTML's rules: quoted values may hold ">". Atomic groups keep this linear in a tag.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=|[\"'])*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTES = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    #: 1 in an article or main element, or within names that say content; 2 in both.
    content: int
    #: 1 in nav, footer, aside, a page's header, or within names that say so.
    boiler: int
    comment: int
    form: int
    heading: int
    item: int
    #: 1 from a heading on that says comments, related and the like, up to the end of its container.
    closing: int
    notice: int


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "longest_near", "content", "boiler", "comment", "form", "heading", "item", "closing", "notice", "seen_content", "outside",
)


def _named(attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """(content, boiler, comment) by an element's class, id and role names.

    A name like "content-sidebar-wrap" or "has-footer" is about what is in or beside the element, and an article's header holds its title.
    """
    content = boiler = comment = False
    for a in ("class", "id", "role"):
        for name in attributes.get(a, "").replace("_", "-").split():
            parts = [p.lower() for p in _NAME_PARTS.findall(name)]
            known = {*parts, "".join(parts)}
            own = bool(known & CONTENT_NAMES)
            content |= own
            comment |= bool(known & COMMENT_NAMES) and not known & BESIDE
            boiler |= bool((known - {"header"} if own else known) & BOILER_NAMES) and not (known & BESIDE or (own and known & WRAPS))
    return content, boiler, comment


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTES.finditer(source)}


class _Open(NamedTuple):
    tag: str
    content: int
    boiler: int
    comment: int
    form: int
    item: int


def is_notice(text: str) -> bool:
    """Whether NOTICE is found; most texts have none of its parts, which is much faster to see."""
    low = text.lower()
    for part in NOTICE_PARTS:
        if part in low:
            return NOTICE.search(text) is not None
    return not text.isascii() and any(c in text for c in _OTHER_CASES) and NOTICE.search(text) is not None


def blocks(source: str | None) -> list[Block]:
    """The text blocks of a page, in its order. Null and empty pages have none; time is linear in the page's length.

    Character references are decoded, runs of white space become one space. Scripts, styles, comments, hidden elements and the
    head aren't text. Broken markup is read to its end: open elements end with the page, stray end tags are ignored.
    """
    source = source or ""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", 0, 0, 0, 0, 0)]
    depth: dict[str, int] = {}
    text: list[str] = []
    linked_words = links = heading = hidden = 0
    closing_at: int | None = None
    lower = None
    pattern = _TAG

    def add(piece: str) -> None:
        nonlocal linked_words
        piece = html.unescape(piece)
        if links:
            linked_words += len(_WORD.findall(piece))
        text.append(piece)

    def end_block() -> None:
        nonlocal linked_words, closing_at
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                top = stack[-1]
                words = len(_WORD.findall(whole))
                if closing_at is None and words <= 6 and (heading or words <= 4) and CLOSING.match(whole):
                    closing_at = max(1, len(stack) - 1 - bool(heading))
                out.append(Block(whole, words, min(linked_words, words), top.content, top.boiler, top.comment, top.form, int(bool(heading)), top.item, int(closing_at is not None), int(is_notice(whole))))
        linked_words = 0

    def close(k: int) -> None:
        """Ends all elements from the stack's k-th on."""
        nonlocal links, heading, hidden, closing_at
        for e in stack[k:]:
            depth[e.tag] -= 1
            links -= e.tag == "a"
            heading -= e.tag in HEADINGS
        del stack[k:]
        if closing_at is not None and len(stack) < closing_at:
            closing_at = None

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        if lt > at:
            add(source[at:lt])
        nxt = source[lt + 1 : lt + 2]
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?") or (nxt == "/" and not source[lt + 2 : lt + 3].isalpha()):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt == "/" or (nxt.isascii() and nxt.isalpha())):
            add("<")
            at = lt + 1
            continue
        m = pattern.match(source, lt)
        if m is None and pattern is _TAG:
            pattern = _PLAIN  # a quote or bracket is never closed: from here on tags end at the next ">"
            m = pattern.match(source, lt)
        if m is None:
            break  # the page ends within a tag
        at = m.end()
        ending, tag = bool(m[1]), m[2].lower()
        if not ending and tag in RAW:
            if lower is None:
                lower = source.lower()
                if len(lower) != n:  # a few letters have longer lower-case forms
                    lower = "".join(c.lower() if c.isascii() else c for c in source)
            if not (m[3].endswith("/") and tag in ("svg", "math")):
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    at = n
                else:
                    end = source.find(">", end)
                    at = n if end < 0 else end + 1
            if tag not in ("svg", "math", "canvas"):
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            end_block()
        if tag in VOID:
            continue
        if ending:
            if depth.get(tag):
                k = len(stack) - 1
                # An inline end tag doesn't end blocks around it.
                while stack[k].tag != tag:
                    k -= 1
                if tag not in INLINE or all(e.tag in INLINE for e in stack[k:]):
                    close(k)
                elif tag == "a":
                    close(k)
            continue
        if tag not in INLINE and depth.get("p"):
            k = len(stack) - 1
            while stack[k].tag != "p":
                k -= 1
            close(k)  # a block ends an open paragraph and what is open in it
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd", "a") and depth.get(tag):
            k = len(stack) - 1
            while stack[k].tag not in (tag, "ul", "ol", "table", "tbody", "select", "dl", "menu"):
                k -= 1
            if stack[k].tag == tag:
                close(k)
        top = stack[-1]
        if tag in INLINE and "=" not in m[3]:
            stack.append(top._replace(tag=tag))
        else:
            attributes = _attributes(m[3]) if m[3].strip() else {}
            if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
                at = _skip(source, at, tag)
                continue
            own, outside, said = _named(attributes)
            inside = tag in ("article", "main") or attributes.get("role") == "main"
            header = tag == "header" and not depth.get("article") and not depth.get("main")
            comment = int(bool(top.comment or said))
            boiler = int(bool(top.boiler or tag in BOILER or header or (outside and tag not in ("body", "html", "article", "main"))))
            stack.append(_Open(tag, min(2, top.content + inside + (own and tag != "body")), boiler, comment, int(top.form or tag in FORM), int(top.item or tag in ("li", "td", "th", "dd"))))
        depth[tag] = depth.get(tag, 0) + 1
        links += tag == "a"
        heading += tag in HEADINGS
        if tag == "article" and top.content and depth[tag] > 1:  # articles within an article are comments or teasers
            stack[-1] = stack[-1]._replace(comment=1)
        if len(stack) > 2000:
            close(1000)  # nothing sensible is that deep: what follows belongs to what is open
    end_block()
    return out


def _skip(source: str, at: int, tag: str) -> int:
    """The end of the element whose start tag ends at ``at``."""
    open_ = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])", re.IGNORECASE).finditer(source, at):
        open_ += -1 if m[1] else 1
        if not open_:
            return source.find(">", m.end()) + 1 or len(source)
    return len(source)


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """The features of each block, in the order of FEATURES; a page's edges count as empty blocks."""
    words = [0, 0, *(b.words for b in found), 0, 0]
    density = [0.0, 0.0, *(b.linked / b.words if b.words else 0.0 for b in found), 0.0, 0.0]
    seen = int(any(b.content and not b.boiler and not b.comment for b in found))
    return [
        (
            float(b.words), density[k + 2], float(words[k + 1]), density[k + 1], float(words[k + 3]), density[k + 3], float(max(words[k : k + 5])),
            float(b.content), float(b.boiler), float(b.comment), float(b.form), float(b.heading), float(b.item), float(b.closing), float(b.notice), float(seen), float(b.boiler + b.comment + b.form + b.closing),
        )
        for k, b in enumerate(found)
    ]


# The labelled table: pages that are put together by rule, in layouts as they are common, with every block's label known.


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """(html, texts of the article's blocks) of ``n`` pages."""
    for k in range(n):
        rng = random.Random(seed * 1_000_003 + k)
        yield _labelled_page(rng, k)


def _sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 9))) for _ in range(words)).capitalize() + "."


def _labelled_page(rng: random.Random, k: int) -> tuple[str, list[str]]:
    layout = ("semantic", "classes", "bare", "mixed")[k % 4]
    prose = lambda low, high: _sentence(rng, rng.randint(low, high))
    link = lambda words: f'<a href="/{rng.randint(1, 99)}">{_sentence(rng, words)[:-1]}</a>'
    named = lambda tag, name, inner: f'<div class="{name}">{inner}</div>' if layout in ("classes", "mixed") else f"<{tag}>{inner}</{tag.split()[0]}>" if layout == "semantic" else f"<div>{inner}</div>"
    kept: list[str] = []

    def keep(tag: str, text: str) -> str:
        kept.append(text)
        return f"<{tag}>{text}</{tag}>"

    menu = named("nav", rng.choice(("menu", "main-nav", "navbar")), "<ul>" + "".join(f"<li>{link(rng.randint(1, 3))}</li>" for _ in range(rng.randint(3, 9))) + "</ul>")
    head = named("header", rng.choice(("site-header", "masthead", "header")), f"<div>{link(2)}</div><p>{prose(3, 8)}</p>")
    notice = rng.choice(("We use cookies to improve this site. You accept our cookie policy if you go on. ", "Please note: this site uses cookies; read the privacy policy. ")) + prose(5, 30)
    notice = named("aside", rng.choice(("cookie-notice", "consent-banner", "notice")), f"<p>{notice}</p><button>OK</button>")
    advert = '<div class="{}">{}</div>'.format(rng.choice(("ad", "advert", "sponsored-box", "promo")), prose(4, 40))
    side = named("aside", rng.choice(("sidebar", "related-posts", "widget")), f"<h3>{_sentence(rng, 2)[:-1]}</h3><ul>" + "".join(f"<li>{link(rng.randint(3, 8))}</li>" for _ in range(rng.randint(2, 7))) + f"</ul><p>{prose(4, 30)}</p>")
    form = f"<form><label>{_sentence(rng, 2)}</label><input><select><option>{_sentence(rng, 1)}</option></select><p>{prose(3, 15)}</p><button>{_sentence(rng, 1)}</button></form>"
    foot = named("footer", rng.choice(("footer", "colophon", "site-footer")), f"<p>&copy; {2000 + k % 25} {prose(3, 12)}</p>" + " ".join(link(2) for _ in range(rng.randint(1, 5))))
    title = _sentence(rng, rng.randint(3, 10))[:-1]
    inner = [keep("h1", title)]
    brief = layout != "bare" and rng.random() < 0.3
    for _ in range(rng.choice((0, 1, 2, 4, 8, 14))):
        kind = rng.random()
        if kind < 0.12:
            inner.append(keep(rng.choice(("h2", "h3")), _sentence(rng, rng.randint(1, 6))[:-1]))
        elif kind < 0.22:
            inner.append("<ul>" + "".join(keep("li", prose(2, 18)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.28:
            inner.append("<blockquote>" + keep("p", prose(5, 40)) + "</blockquote>")
        elif kind < 0.36:
            a, b = prose(5, 30), prose(1, 3)
            kept.append(f"{a} {b}")
            inner.append(f'<p>{a} <a href="/x">{b}</a></p>')
        elif kind < 0.42:
            inner.append(advert)
        elif kind < 0.5 and layout != "bare":  # articles speak of these things, too
            about = rng.choice(("All rights reserved.", "Read the privacy policy.", "Our newsletter", "© 2019", "This site uses cookies."))
            inner.append(keep("p", f"{prose(1, 30)} {about} {prose(1, 30)}"))
        elif kind < 0.58 and layout != "bare":
            text = prose(2, 12)
            kept.append(text)
            inner.append(f'<p><a href="/y">{text}</a></p>')
        else:
            inner.append(keep("p", prose(1, 8) if brief else prose(rng.choice((1, 3, 10, 30)), rng.choice((30, 60, 140)))))
    inner.append(keep("p", prose(1, 8 if brief else 90)))
    said = rng.random() < 0.6
    title_of = "" if layout != "bare" and rng.random() < 0.4 else f"<h3>{rng.choice(('Comments', '3 Comments', 'Discussion', 'Reader comments'))}</h3>"
    comments = named("section class=" + rng.choice(("comments", "discussion")) if layout == "semantic" else "section", rng.choice(("comments", "comment-list", "reader-comments")), title_of + "".join(f'<div class="{rng.choice(("comment", "c", "reply"))}"><b>{_sentence(rng, 1)}</b><p>{prose(3, 70)}</p></div>' for _ in range(rng.randint(1, 5)))) if said else ""
    body = "".join(inner)
    if k % 5 in (1, 3):  # what isn't the article may stand in its container too
        late = [comments, side, form if k % 2 else "", notice if k % 7 < 3 else ""]
        rng.shuffle(late)
        body += "".join(late)
        comments = side = form = notice = ""
    if layout == "semantic":
        body = f"<main><article>{body}</article></main>" if k % 3 else f"<article>{body}</article>"
    elif layout == "classes":
        body = f'<div class="{rng.choice(("article-body", "post-content", "entry", "story"))}">{body}</div>'
    elif layout == "mixed":
        body = f'<div id="main"><div class="row">{body}</div></div>'
    else:
        body = f"<div>{body}</div>"
    parts = [head, menu, notice if k % 3 == 0 else "", advert if k % 2 else "", body, comments, side, form if k % 4 in (1, 2) else "", foot]
    return f"<html><head><title>{title}</title></head><body>" + "".join(parts) + "</body></html>", kept


def labelled_blocks(spark: SparkSession, pages: int = LABELLED_PAGES) -> DataFrame:
    """(features, label) of every block of the labelled pages: 1 for the article's."""
    rows = []
    for source, kept in labelled_pages(pages):
        found, left = blocks(source), list(kept)
        for b, x in zip(found, features(found), strict=True):
            label = float(bool(left) and b.text == left[0])
            if label:
                left.pop(0)
            rows.append((list(x), label))
        if left:
            raise ValueError(f"labelled blocks that weren't found: {left[:3]}")
    return spark.createDataFrame(rows, "features array<double>, label double")


def train(spark: SparkSession, pages: int = LABELLED_PAGES, depth: int = TREE_DEPTH) -> list[tuple]:
    """A decision tree over labelled blocks, as nodes (feature, threshold, left, right) or (-1, label, 0, 0); its root comes first."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    rows = labelled_blocks(spark, pages).coalesce(1).select(array_to_vector("features").alias("features"), "label")
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=4, maxBins=64, seed=1).fit(rows)
    nodes: list[tuple] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, node.prediction(), 0, 0)
        else:
            split = node.split()
            nodes[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))
        return at

    walk(model._java_obj.rootNode())
    return nodes


def classify(tree: list[tuple], x: tuple[float, ...]) -> bool:
    at = 0
    while tree[at][0] >= 0:
        feature, threshold, left, right = tree[at]
        at = left if x[feature] <= threshold else right
    return tree[at][1] > 0.5


def main_text(tree: list[tuple], source: str | None) -> tuple[str, int, int]:
    """(text, number of blocks, number of blocks kept)."""
    found = blocks(source)
    kept = [b.text for b, x in zip(found, features(found), strict=True) if classify(tree, x)]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, page: str = "html", tree: list[tuple] | None = None) -> DataFrame:
    """``pages`` with text (the main text, blocks joined by line ends; empty if there is none), n_chars, n_blocks and n_kept.

    Columns of these names are replaced; others keep any name. Null and empty pages have an empty text, pages of any length are read whole, in
    linear time; repeated rows and an empty table stay as they are.
    """
    tree = tree or train(pages.sparkSession)
    base = pages.drop("text", "n_chars", "n_blocks", "n_kept") if page not in ("text",) else pages
    rows = numbered(base)
    place = base.columns.index(page)
    schema = rows.limit(0).schema
    for name, kind in (("text", "string"), ("n_chars", "long"), ("n_blocks", "long"), ("n_kept", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, size, found = 0, 0, []
            for k in range(b.num_rows):
                source = b.column(place)[k].as_py()
                found.append(main_text(tree, source))
                size += len(source or "")
                if size > PART or k + 1 == b.num_rows:
                    texts, n, kept = zip(*found, strict=True)
                    made = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (map(len, texts), n, kept))]
                    yield pa.RecordBatch.from_arrays([*b.slice(begin, k + 1 - begin).columns, *made], names=schema.names)
                    begin, size, found = k + 1, 0, []

    return rows.mapInArrow(run, schema).toDF(*base.columns, "text", "n_chars", "n_blocks", "n_kept")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")
