"""Main text of web pages: flat text blocks, judged by a decision tree that is trained on labelled blocks.

A page is cut into blocks at the tags that start or end one. Each block has its number of words, its link
density, those of the blocks before and after it, and what it lies in: a heading, list item or cell, and
containers that by their tag or by a word of their class, id or role hold menus, adverts, notices, forms or
comments. A decision tree, grown on a small labelled table of pages, tells article blocks from the rest.

A form, or an element marked by a word alone, may be a wrapper around the page. It does not count as such a
container when it holds the article or main container with the most words. On pages without such a container
that holds for a form with half of the words, and for what holds all words and a marked part besides; words in
links and in nav, aside, header, footer and the like are left out. Marked parts inside stay marked.

* Null and empty pages have no text. Scripts, styles, comments, and other parts that browsers don't show
  are no text. Character references are decoded, white space inside a block becomes one space.
* Broken pages are read as far as they go: tags that are never closed end with the page, an end tag
  without its start is skipped, an unfinished tag at the end is dropped.
* Whole pages are read. Repeated rows give equal answers, an empty table an empty result; other columns
  are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table

# Names of HTML elements by what they do to text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = frozenset("script style noscript template title textarea iframe object svg math canvas audio video select head".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of one of these ends, unless something of its own kind lies between.
ENDED_BY = {"p": BLOCK_TAGS - {"br", "button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
BOUNDARY = frozenset("ul ol dl table tbody thead tfoot div section article aside nav main header footer form blockquote td th li body html".split())

# Containers by tag, and by words in class, id and role.
SIDE_TAGS = frozenset("nav aside footer header form menu dialog button fieldset search".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent contentinfo cookie cookies "
    "copyright dialog disqus footer form header login menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "popup promo promotion promoted recommended related search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription toolbar topbar widget alert complementary cookiebar masthead reply replies respond responses discussion gdpr".split()
)
#: Words that may stand beside one of these in a joined name, as in "related-posts"; "related-work" is no such name.
PART_WORDS = frozenset(
    "area bar big block bottom box btn button buttons card center col column container fixed global group hidden icon icons inner item items js left "
    "link links list menu mobile modal module nav news outer page panel pane post posts primary right row secondary section site slot small sticky stories "
    "story top unit users view wrap wrapper zone article articles content entry main text body form input field message policy settings tools meta".split()
)
#: Side elements that never wrap a page.
PART_TAGS = SIDE_TAGS - {"form", "fieldset"}
#: Class words of what an element has or lacks, as in "has-sidebar": they don't say what it is.
HAVING = re.compile(r"(?:has|have|no|with|without)[-_]")
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content entry main post story text body".split())

#: Tags as HTML reads them: a quote opens a value only after an equals sign, anywhere else it is part of a name.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:until-found|false))|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
WORDS = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class _Open:
    tag: str
    side: bool
    main: bool
    hidden: bool
    link: bool
    before: dict = field(default_factory=dict)


@dataclass
class Block:
    text: str
    linked: int  # words inside links
    words: int
    heading: bool
    item: bool
    cell: bool
    side: bool  # inside a container that holds no article text by its name
    main: bool
    marks: tuple[_Open, ...] = ()  # the open side and main elements, outermost first


def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's name or attributes mark it as beside the article, as the article, as not shown."""
    names: set[str] = set()
    if "=" in attributes:
        for _, *values in NAMED.findall(attributes):
            for value in values:
                for name in value.lower().split():
                    if HAVING.match(name):
                        continue
                    joined = WORDS.findall(name)
                    names.add(name)
                    names.update(w for w in joined if w in MAIN_WORDS)
                    if all(w in SIDE_WORDS or w in PART_WORDS or w.isdigit() for w in joined):
                        names.update(joined)
    if tag in ("body", "html"):
        return False, False, False
    main = tag in MAIN_TAGS or bool(names & MAIN_WORDS)
    side = tag in SIDE_TAGS or bool(names & SIDE_WORDS)
    return side, main and not side, tag in HIDDEN_TAGS or bool(HIDDEN.search(attributes)) if attributes else tag in HIDDEN_TAGS


def blocks(page: str | None) -> list[Block]:
    """The shown text of a page in flat blocks, in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[tuple[str, bool]] = []
    at, end = 0, len(page or "")
    page = page or ""

    def flush() -> None:
        if not parts:
            return
        text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
        if text:
            tags, marks = {o.tag for o in stack}, tuple(o for o in stack if o.side or o.main)
            linked = len("".join(p if l else " " for p, l in parts).split())
            side, main = any(o.side for o in marks), any(o.main for o in marks)
            out.append(Block(text, linked, len(text.split()), bool(tags & HEADINGS), bool(tags & {"li", "dt", "dd"}), bool(tags & {"td", "th"}), side, main, marks))
        parts.clear()

    def text(to: int) -> None:
        if to > at and not any(o.hidden for o in stack[-1:]):
            parts.append((html.unescape(page[at:to]), any(o.link for o in stack)))

    def opened(tag: str, attributes: str) -> None:
        side, main, hidden = _kind(tag, attributes)
        above = stack[-1] if stack else None
        if tag == "header" and side:
            inner = next((o for o in reversed(stack) if o.side or o.main), None)
            if inner is not None and inner.main:  # the head of an article holds its title
                side = _kind("div", attributes)[0]
        stack.append(_Open(tag, side, main, hidden or bool(above and above.hidden), tag == "a"))

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            text(end)
            break
        text(found.start())
        at = found.end()
        closing, tag, attributes = found[1] or found[4], (found[2] or found[5] or "").lower(), found[3] or ""
        if not tag:
            continue
        if closing:
            if tag == "br" or tag == "p" and all(o.tag != "p" for o in stack):
                flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if tag in BLOCK_TAGS or any(o.tag in BLOCK_TAGS for o in stack[i:]):
                        flush()
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDARY and tag not in BLOCK_TAGS:
                    break
            continue
        if tag in BLOCK_TAGS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if tag in ENDED_BY.get(stack[i].tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDARY:
                    break
        if tag in VOID_TAGS:
            continue
        if attributes.endswith("/") and tag in ("svg", "path", "use"):
            continue
        opened(tag, attributes)
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            stack.pop()
    flush()
    _unwrap(out)
    return out


def _unwrap(found: list[Block]) -> None:
    """Clear the side mark of blocks that lie in nothing but wrappers of the page."""
    if not any(b.side for b in found):
        return
    own: dict[_Open, int] = {}  # words of each main container outside of side parts of its own
    above: dict[_Open, tuple[_Open, ...]] = {}
    held: dict[_Open, int] = {}  # words of each side element that may be a wrapper
    whole: set[_Open] = set()  # those that hold a side part
    total = 0
    for b in found:
        free = 0 if any(o.side and o.tag in PART_TAGS for o in b.marks) else b.words - b.linked
        total += free
        last = max((i for i, o in enumerate(b.marks) if o.side), default=0)
        whole.update(b.marks[:last])
        for i in range(len(b.marks) - 1, -1, -1):
            if b.marks[i].side:
                break
            own[b.marks[i]] = own.get(b.marks[i], 0) + b.words
            above[b.marks[i]] = b.marks[:i]
        for o in b.marks:
            if o.side and o.tag not in PART_TAGS:
                held[o] = held.get(o, 0) + free
    inside = {o: n for o, n in own.items() if not any(a.side and a.tag in PART_TAGS for a in above[o])}
    if inside:
        wrappers = {a for a in above[max(inside, key=lambda o: inside[o])] if a.side}
    else:
        wrappers = {o for o, n in held.items() if n == total > 0 and o in whole or o.tag == "form" and 2 * n >= total > 0}
    if wrappers:
        for b in found:
            b.side = any(o.side and o not in wrappers for o in b.marks)


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "item", "cell", "side", "main", "article_on_page")


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of it and of its neighbours, and what it lies in."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / max(1, b.words) for b in found), 0], float)
    inside = np.array([[b.heading, b.item, b.cell, b.side, b.main] for b in found], float).reshape(-1, 5)
    page = np.full(len(found), float(any(b.main for b in found)))
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], inside, page])


# The labelled table. Each line is a page; [[ ]] enclose the blocks of its article.
LABELLED = (
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav><article><h1>[[A quiet harbour]]</h1><p>[[The boats came in before noon and the nets were dry by two.]]</p><p>[[Short.]]</p><p>[[Nobody spoke of the storm, though all of them had <a href='/s'>seen it</a> coming.]]</p></article><footer>All rights reserved by the harbour office and its partners in town.</footer>",
    "<div class='ad'>Buy the best nets of the season, now at half the price for everyone.</div><article><h1>[[On bread]]</h1><p>[[Flour, water and salt.]]</p><ul><li>[[Rye needs more time]]</li><li>[[Wheat needs less]]</li></ul></article><aside><p>More about baking can be found in our shop, which is open all day.</p></aside>",
    "<header><h1>The Daily Page</h1><p>News from all over the valley, every day of the year</p></header><div id='content'><h2>[[Snow on the pass]]</h2><p>[[The road has been closed since Friday and will open when the ploughs get through.]]</p><p>[[Drivers should wait.]]</p></div><div class='comments'><p>I was there and it was not as bad as you write in this article.</p></div>",
    "<body><ul class='menu'><li><a href='a'>Start</a></li><li><a href='b'>About us</a></li><li><a href='c'>Contact</a></li></ul><h1>[[Planting trees]]</h1><p>[[Dig a hole twice as wide as the roots and set the tree upright in the middle of it.]]</p><p>[[Water it.]]</p><p><a href='x'>Next page</a> <a href='y'>Previous page</a></p></body>",
    "<div><a href='1'>One</a> <a href='2'>Two</a> <a href='3'>Three</a></div><div><p>[[There was a time when letters took a week, and people wrote with that in mind.]]</p><p>[[They said more with less.]]</p><p>[[See the <a href='/m'>museum</a> for examples of such letters from that time.]]</p></div><div><a href='4'>Imprint</a> <a href='5'>Privacy</a></div>",
    "<main><h1>[[Results of the race]]</h1><table><tr><th>[[Name]]</th><th>[[Time]]</th></tr><tr><td>[[Anna]]</td><td>[[12.4]]</td></tr></table><form><label>Your mail</label><p>Get our letter every week by leaving your address here.</p></form></main>",
    "<div class='cookie-notice'><p>We use cookies to make this site work as well as it can for you.</p></div><article><p>[[<a href='/only'>A paragraph that is a link from its first word to its last one, in an article</a>]]</p><blockquote>[[And a quote.]]</blockquote><div class='share'><a href='f'>Share</a></div></article>",
    "<p>Thank you for reading the paper of the valley, which lives from its readers.</p><article><h2>[[Rain]]</h2><p>[[It fell for nine days and the cellars of the lower town were full of water.]]</p><p>[[Then it stopped.]]</p></article><div><p>Write to the editors if you have seen the flood, they want to hear from you.</p></div>",
    "<div><h3>Read next</h3><p>Why the lower town floods so often and what could be done about it.</p></div><main><p>[[Pumps ran through the night.]]</p><p>[[By morning the square was dry and the market opened as on any other day.]]</p></main>",
    "<div class='sidebar'><h3>Latest</h3><ul><li><a href='q'>A new bridge</a></li><li>Weather for the coming week in the whole valley</li></ul></div><div class='post'><h1>[[Old bridges]]</h1><p>[[Stone lasts.]]</p><p>[[Wood does not last, but it is quick to build with and easy to mend in spring.]]</p></div>",
    "<form id='aspnetForm'><div class='menu'><a href='m'>Menu</a></div><article><h1>[[The last ferry]]</h1><p>[[It leaves at nine, and who comes later has to take the long road around the lake.]]</p></article><div class='comments'><p>I have missed it twice this year and the road is in a bad state.</p></div></form>",
    "<div class='layout sidebar-left'><div class='sidebar'><p>The most read stories of the week from all parts of the valley.</p></div><div class='content'><p>[[Mist.]]</p><p>[[It came up from the river at dawn and stayed in the streets until noon.]]</p></div></div>",
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features of the labelled table's blocks, and which of them are article text."""
    rows, labels = [], []
    for page in LABELLED:
        found = blocks(page)
        labels += [b.text.startswith("[[") for b in found]
        for b in found:
            b.text = b.text.replace("[[", "").replace("]]", "")
            b.words = len(b.text.split())
        rows.append(features(found))
    return np.concatenate(rows), np.array(labels)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 5, least: int = 1):
    """A decision tree by Gini impurity: ``(feature, threshold, below, above)``, or whether a leaf is article text.

    Ties between splits go to the feature that comes last in FEATURES, as those say what a block lies in.
    """
    share = labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for f in range(rows.shape[1] - 1, -1, -1):
        values = np.unique(rows[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            below = rows[:, f] <= threshold
            n = below.sum()
            if min(n, len(labels) - n) < least:
                continue
            p, q = labels[below].mean(), labels[~below].mean()
            impurity = n * p * (1 - p) + (len(labels) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, float(threshold), below)
    if best is None:
        return bool(share >= 0.5)
    _, f, threshold, below = best
    return (f, threshold, grow(rows[below], labels[below], depth - 1, least), grow(rows[~below], labels[~below], depth - 1, least))


def decide(tree, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        f, threshold, below, above = tree
        tree = below if row[f] <= threshold else above
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    tree = grow(*labelled_blocks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py(), tree) for t in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
