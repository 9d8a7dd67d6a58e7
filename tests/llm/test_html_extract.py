import pytest

from linkloom.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string"
TREE = H.grow(*H.labelled_blocks())
ARTICLE = "<article><h1>A &amp; B</h1><p>First  line\n of&nbsp;it&#x21; <b>bold</b><i>er</i></p><p>Short.</p><ul><li>one item</li><li>two</li></ul></article>"
TEXT = "A & B\nFirst line of it! bolder\nShort.\none item\ntwo"


@pytest.mark.parametrize(
    "before, after",
    [
        ("", ""),
        ("<html><head><title>T</title><style>p{}</style><script>var t='</p><p>no</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav>", "<footer>(c) and a long line of words that no reader ever reads to its end</footer></body></html>"),
        ("<!-- <p>hidden</p> --><div class='ad'>Buy this thing now, it is the best of all things you can buy today.</div>", "<section id='comments'><p>I think that this is a really good article, thank you for it.</p></section>"),
        ("<div role='navigation'><p>Some words about where to go from here on this site of ours</p></div>", "<aside><p>Related things that are worth a look</p></aside>"),
        ("<form><p>Leave your address here and we write to you</p><input name=q></form>", "<footer>never closed"),
        ("<p style='display:none'>not shown at all, whatever it says here</p>", "<div class='cookie-banner'>We use cookies</div><p"),
    ],
)
def test_article_alone_is_kept(before, after):
    assert H.main_text(before + ARTICLE + after, TREE) == TEXT


def test_parts_inside_the_article_that_are_not_the_article():
    page = "<article><p>One two three.</p><div class='advert'>An advert inside of the article, longer than the text</div><p>Four five.<div class=comments><p>nice one</p></div></article>"
    assert H.main_text(page, TREE) == "One two three.\nFour five."


SIDES = "<div class='menu'><p>Some words about where to go from here on this site of ours</p></div>", "<div class='comments'><p>I think that this is a really good article, thank you for it.</p></div>"


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>", "<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<div class='with-comments'>", "<div class='page sidebar-right'>", "<form><div class='header-fixed'>"])
@pytest.mark.parametrize("article", [ARTICLE, ARTICLE.replace("article>", "div>"), ARTICLE.replace("<article>", "<div class=content>").replace("</article>", "</div>")])
def test_wrappers_of_the_page_keep_the_article_and_not_the_parts_beside_it(wrapper, article):
    close = "</div></form>" if "><" in wrapper else f"</{wrapper[1:].split()[0].strip('>')}>"
    inside = SIDES[0] + article + SIDES[1]
    assert H.main_text(wrapper + inside + close, TREE) == TEXT
    assert H.main_text("<nav><a href='/x'>x</a></nav>" + wrapper + inside + close + "<footer>(c) and a long line of words that no reader ever reads</footer>", TREE) == TEXT


def test_side_parts_with_articles_of_their_own_stay_out():
    beside = "<aside><article><p>Related: a teaser of another text that is longer than all of the article itself, by far and on purpose, so that words alone don't decide it.</p></article></aside>"
    assert H.main_text(ARTICLE + beside, TREE) == TEXT
    assert H.main_text(ARTICLE + "<section id='comments'><article><p>nice one</p></article></section>", TREE) == TEXT


def test_broken_and_plain_pages():
    assert H.main_text(None, TREE) == H.main_text("", TREE) == H.main_text("<nav>a</nav>", TREE) == ""
    assert H.main_text("just text, no tag, 1 < 2", TREE) == "just text, no tag, 1 < 2"
    assert H.main_text("<article><p>never<p>closed<b>bold<p>end", TREE) == "never\nclosedbold\nend"
    assert H.main_text("</div></p><article>a</span>b</article>", TREE) == "ab"
    long = "<article>" + "<p>word &lt;tag&gt;</p>" * 20000 + "</article>"
    assert H.main_text(long, TREE) == "\n".join(["word <tag>"] * 20000)
    assert H.main_text("<article>" + "<div>" * 400 + "deep" + "</div>" * 400, TREE) == "deep"


def test_tree_fits_its_table_and_uses_link_density_of_blocks():
    rows, labels = H.labelled_blocks()
    assert all(H.decide(TREE, r) == y for r, y in zip(rows, labels, strict=True))
    page = "<div><a href='1'>One page</a> <a href='2'>Two</a></div><div><p>There was a time when nobody had to click on anything, and it was good.</p></div>"
    assert H.main_text(page, TREE) == "There was a time when nobody had to click on anything, and it was good."


def test_query_on_odd_tables(spark, folder_of):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (2, None, None, "y"), (None, "v", "<p>x", None)]
    out = H.op1_html_extract(spark, folder_of("pages", rows, SCHEMA)).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out), key=str) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "x", 1)], key=str)
    assert H.op1_html_extract(spark, folder_of("pages", [], SCHEMA, 1)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>One two.</p><p title='it's'>Three four.</p><p>don't stop</p></article>", "One two.\nThree four.\ndon't stop"),
        ("<article><p a=\"x>y\" b='>' c=d/>Text</p><p =x>b</p><p \"q>c</p><p t=\"u>d</p></article>", "Text\nb\nc\nd"),
        ("<article><p>One.</p><section class='related-work'><p>Others found the same.</p></section></article>", "One.\nOthers found the same."),
        ("<article><p>One.</p><div class='search-results-analysis'><p>Results are here.</p></div></article>", "One.\nResults are here."),
        ("<header class='site-header'><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Text of it.</p></article>", "Title\nText of it."),
        ("<article><p>Text of it.</p><div id='responses'><p>nice one</p></div><div class='related-posts'><p>more</p></div></article>", "Text of it."),
        ("<article><p>Text.</p><div class='cookie-banner-2'>We use cookies</div><div class='post-comments'>nice</div></article>", "Text."),
    ],
)
def test_stray_quotes_and_joined_names(page, text):
    assert H.main_text(page, TREE) == text


@pytest.mark.parametrize("tail", ["a=b " * 100_000, "a='" * 100_000, "a=" * 100_000, "' " * 100_000])
def test_tags_that_never_end_take_no_quadratic_time(tail):
    import time

    start = time.time()
    H.main_text("<article><p>x</p><p " + tail, TREE)
    assert time.time() - start < 2
