import random
import re
import time

import pytest
from pyspark.sql import functions as F

from linkloom.functions import html, patterns, text, urls


def resolve(spark, pairs):
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    df = df.withColumn("base", urls.split_url(F.col("b")))
    return [(x.resolved, x.resolved_canon) for x in urls.with_resolved(df, "base", "r").orderBy("i").collect()]


def test_decode(apply):
    values = ["a%2Fb+c", "a%2Fb%zz+c", "\\u002f\\u0026", "\\u002F", "a+b", "%2541", "%+1"]
    assert apply(text.decoded, *values) == ["a/b c", "a%2Fb%zz+c", "/&", "\\u002F", "a b", "%41", "%+1"]


def test_one_line(apply):
    assert apply(text.one_line, "  a\r\n\tb \n", "x") == ["a b", "x"]


def test_noise(apply):
    noisy = ["application/json", "12/31/2025", "/a/{{x}}", "/t/:id", "  ", "api/users"]
    assert apply(text.is_noise, *noisy, "/api/v1", "api/users/x") == [True] * 6 + [False] * 2


def test_noise_is_one_look_at_a_token(apply, strings):
    noisy = ["", "\t\u00a0", "\u2003text/html \n", " 1/2/2025\r", " {{", "x /: y"]
    assert apply(text.is_noise, *noisy, "text/h tml", "1/2/20255", "a", " /text/html ", None) == [True] * 6 + [False] * 4 + [None]
    plan = strings("x").select(text.is_noise(F.col("s")).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") == 1 and "regexp_replace" not in plan


def test_text_that_needs_nothing_is_not_written_anew(apply):
    plain = ["", "a.b", "\\u00", "\\u002F", "%", "a%2", None]
    assert apply(text.decoded, *plain) == plain
    assert apply(text.decoded, "%5Cu002f+", "\\u002f%zz+", "+\\u0026", "%41+\\u002f") == ["/ ", "/%zz+", " &", "A /"]
    assert apply(text.one_line, "", "a", "\u00a0a\u2003", "a \t\tb", None) == ["", "a", "a", "a  b", None]
    hosts = ["a_.b-c", "_a", "-a", "a-", ".a", "20a.b", "A.b", "*.a.b", " a", "a*", "", None]
    assert apply(text.clean_host, *hosts) == ["a_.b-c", "_a", "a", "a", "a", "a.b", "a.b", "a.b", "a", "a*", "", None]


@pytest.mark.parametrize("pattern", [patterns.HOST_RUN, patterns.BUCKET])
def test_dotted_words_hold_every_host_and_bucket(apply, pattern):
    random.seed(5)
    parts = [" ", "\t", "\n", ".", "-", "_", "/", "//", "a", "b.s3.amazonaws.com", "S3.amazonaws.com/x", "s3-eu.amazonaws.com/y", "\u00e9", '"', "k.s3-website-eu"]
    bodies = ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(800)]
    found = [apply(lambda c, t=t: F.regexp_extract_all(t(c), F.lit(pattern), F.lit(0)), *bodies) for t in (lambda c: c, text.dotted_words)]
    assert found[0] == found[1] and any(found[0])


def test_clean_host(apply):
    values = ["2fapi.example.com", "2021.example.com", "*.A.example.com", "-.a.b", "--x--"]
    assert apply(text.clean_host, *values) == ["api.example.com", "21.example.com", "a.example.com", "a.b", "x"]


def test_canonical(spark, strings):
    cases = {
        "http://h:80#f": "http://h/",
        "https://h:443/a?b=1#f": "https://h/a?b=1",
        "https://h:80/a": "https://h:80/a",
        "https://h/für": "https://h/f%C3%BCr",
        "https://h/a b!": "https://h/a%20b%21",
        "https://h/a!%41": "https://h/a!%41",
        "https://h/ü%41%2f%2A": "https://h/%C3%BCA/%2A",
        "HTTP://H/x": "http://H/x",
        "https://h?q=ü": "https://h/?q=ü",
        "https://u:p@h:443/": "https://u:p@h/",
        "https://h/%zz": None,
        "https://h:8x/": None,
        "http://[::1]:80/a": "http://::1/a",
        ":x": None,
        "a:b/c": "a:b/c",
        "1a:b/c": None,
        "https://h/a\nb": None,
        "https://h /a": None,
        "https://h/a?%zz": "https://h/a?%zz",
        "https://h/#%zz": None,
    }
    df = urls.with_canonical(strings(*cases), "s").orderBy("i")
    assert [r.canonical for r in df.collect()] == list(cases.values())


def test_resolve(spark):
    base = "https://h/a/b?x=1#top"
    cases = [
        ("/c", "https://h/c"),
        ("c", "https://h/a/c"),
        ("../c", "https://h/c"),
        ("../../../c", "https://h/c"),
        ("./", "https://h/a/"),
        ("..", "https://h/"),
        ("/a/..", "https://h/"),
        ("/a/b/..", "https://h/a/"),
        ("/a/./b/../c", "https://h/a/c"),
        ("/a//../b", "https://h/a/b"),
        ("//cdn/x/../y", "https://cdn/y"),
        ("", "https://h/a/b?x=1#top"),
        ("?y", "https://h/a/b?y"),
        ("#z", "https://h/a/b?x=1#z"),
        ("http://o", "http://o"),
        ("mailto:a@b", "mailto:a@b"),
        ("a%zz", None),
        ("b:c/d", "b:c/d"),
        ("2b:c", None),
        ("///x", "https://h///x"),
    ]
    assert [r for r, _ in resolve(spark, [(base, ref) for ref, _ in cases])] == [out for _, out in cases]
    assert resolve(spark, [("https://h", "x"), ("https://h", "")]) == [
        ("https://h/x", "https://h/x"),
        ("https://h", "https://h/"),
    ]


def test_static_and_extension(apply):
    static = ["/a.PNG?v=1", "/a.css#x", "/a.woff2", "/a.js", "/a.png/b"]
    assert apply(lambda c: c.rlike(patterns.STATIC_ASSET), *static) == [True, True, True, False, False]
    assert apply(urls.extension, "/a.js", "/a.JS", "/a.b/c", "/x.min.js") == [".js", ".JS", "", ".js"]


def test_quoted_links(apply):
    def scan(c):
        return F.regexp_extract_all(c, F.lit(patterns.QUOTED_LINK), F.lit(1))

    bodies = [
        'fetch("/api/v1/u?x=1")',
        "\"//cdn.h.com/a.js\" 'b.php?x' \"img/a.png\" \"a/bc\"",
        '"/ab"/bc"',
        '"/a"',
    ]
    assert apply(scan, *bodies) == [["/api/v1/u?x=1"], ["//cdn.h.com/a.js", "b.php?x", "img/a.png"], ["/ab"], []]


def test_buckets(apply):
    def scan(c):
        return F.regexp_extract_all(c, F.lit(patterns.BUCKET), F.lit(0))

    bodies = [
        "b.s3.amazonaws.com //s3.amazonaws.com/b1/k",
        "b.s3-us-west-2.amazonaws.com",
        "d.s3-website-us-east-1.amazonaws.com",
    ]
    assert apply(scan, *bodies) == [["b.s3.amazonaws.com", "//s3.amazonaws.com/b1"], [], ["d.s3-website-us"]]


def test_bucket_scan_matches_a_plain_search(spark):
    """Against the plain alternatives, which backtrack but mean the same."""
    plain = re.compile(
        r"[a-z0-9.-]+\.s3\.amazonaws\.com|[a-z0-9.-]+\.s3-[a-z0-9-]\.amazonaws\.com"
        r"|[a-z0-9.-]+\.s3-website[.-](?:eu|ap|us|ca|sa|cn)"
        r"|//s3\.amazonaws\.com/[a-z0-9._-]+|//s3-[a-z0-9-]+\.amazonaws\.com/[a-z0-9._-]+",
        re.I,
    )
    draw = random.Random(3)
    parts = [".s3", ".amazonaws.com", ".s3-a", ".s3-website-us", "//s3", "//s3-x", "/k_1", ".", "-", "a", "B9", " ", "_", ".S3"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    found = df.select("i", F.regexp_extract_all("s", F.lit(patterns.BUCKET), F.lit(0)).alias("v")).orderBy("i")
    wrong = [(texts[r.i], r.v) for r in found.collect() if r.v != plain.findall(texts[r.i])]
    assert wrong == []


def test_start_tags_and_attributes(apply):
    doc = (
        "<!-- <a href='/no'> --><base href='/b/'><script src=/x.js>var a='<a href=\"/no2\">';</script>"
        '<a title="x>y href=/z" href="/yes">t</a><A HREF=/u>k</A><abbr href=no><input type=file>'
        "<noscript><a href=/no3></noscript><form action><link href='q\"q'><a data-href=/no4><a href=/cut"
    )
    tags = apply(html.start_tags, doc)[0]
    assert [t[:7].lower() for t in tags] == [
        "<base h", "<script", "<a titl", "<a href", "<input ", "<noscri", "<form a", "<link h", "<a data",
    ]
    assert apply(lambda c: html.attribute(c, "href"), *tags)[2:4] == ["/yes", "/u"]
    assert apply(lambda c: html.attribute(c, "href"), tags[7], "<a href='?a=1&amp;b'>") == ['q"q', "?a=1&b"]
    assert apply(lambda c: html.has_attribute(c, "href"), tags[8], "<a href>", "<a\nHREF = x>") == [False, True, True]
    assert apply(lambda c: html.has_attribute(c, "action"), "<form>", "<form action>") == [False, True]


def test_browser_reference(apply):
    values = [" /a\n", "/a\\b?c\\d", "/50%", "/a?q=ü x", "/p?x=1#y z"]
    assert apply(html.browser_reference, *values) == ["/a", "/a/b?c\\d", "/50%25", "/a?q=%C3%BC%20x", "/p?x=1#y z"]


@pytest.mark.parametrize(
    "body, pattern, group",
    [
        ('"' + "ab/c" * 250_000 + '!"', patterns.QUOTED_LINK, 1),
        ("a-b." * 250_000, patterns.BUCKET, 0),
        ("a." * 50_000 + "example.com", patterns.HOST_RUN, 0),
        ("x" * 1_000_000, patterns.HOST_RUN, 0),
        ("a." * 50_000 + "example.com", patterns.DNS_LABELS + "example[.]com", 0),
        ("<a x" * 250_000, patterns.TAGS, 1),
        ("<a x=y " + "b=c " * 250_000 + ">", patterns.TAGS, 1),
        ("<script>" * 100_000, patterns.TAGS, 1),
        ("<!--" * 250_000, patterns.TAGS, 1),
    ],
)
def test_scans_stay_linear_on_hostile_bodies(apply, body, pattern, group):
    start = time.time()
    apply(lambda c: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))), body)
    assert time.time() - start < 20


def test_hostile_urls_stay_cheap(spark):
    start = time.time()
    deep = "/a" * 100_000 + "/../b" * 50
    resolve(spark, [("https://h/x", deep), ("https://h/x", "/" + "%41" * 300_000), ("https://h/x", "/" + "ü " * 20_000)])
    assert time.time() - start < 30


def test_canonical_is_idempotent(spark):
    draw = random.Random(7)
    tails = ["".join(draw.choices("ab./?#:%20ü~! ", k=draw.randint(0, 12))) for _ in range(4000)]
    rows = [(i, f"http://h:80/{t}") for i, t in enumerate(tails)]
    df = urls.with_canonical(spark.createDataFrame(rows, "i int, s string"), "s", "c1").where("c1 is not null")
    again = urls.with_canonical(df, "c1", "c2").where("c2 is null or c1 <> c2")
    assert again.select("s", "c1", "c2").limit(5).collect() == []
