"""Golden pages: one rule each, through the whole discovery plan."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import extract, frontier, scope, sinks
from linkloom.plans import discovery
from linkloom.sources import fixtures, ingest
from linkloom.session import materialized, scratch_path

from places import MEDIUM, SMALL

RULES = ["com", "net", "org", "ua", "com.ua", "*.ck", "!www.ck"]


@pytest.fixture
def seeds(spark):
    def build(*targets, **options):
        rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
        raw = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "seed_id long, raw string")
        return materialized(scope.scope_rules(scope.normalize_targets(raw, rules), **options))

    return build


def pages_of(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def outputs(df):
    return sorted((r.kind, r.output) for r in df.select("kind", "output").collect())


GOLDEN = [
    ("https://h.com/", '<a href="/xy">1</a><a href="/x">2</a><a href="#top">3</a><a href="/a.png">4</a>'),
    ("https://h.com/f", '<form action=/go><input type="file"><script src="/j/app.min.js"></script>'),
    ("https://h.com/g", "<form><input type='text'><script src='https://cdn.net/v.js'></script><!-- <a href=/no> -->"),
    ("https://h.com/t", "see 2fapi.h.com a.h.community and bk.s3.amazonaws.com 'x.map' '/d/e.map' '/t/:id'"),
    ("https://other.org/", '<a href="/zz">off</a>'),
    ("https://h.com/b", "<base href='/base/'><a href=rel>r</a><a href='//h.com:443/p'>q</a>"),
]
EXPECTED = [
    ("aws", "bk.s3.amazonaws.com"),
    ("form", "https://h.com/f"),
    ("href", "https://h.com/base/rel"),
    ("href", "https://h.com/x"),
    ("javascript", "https://cdn.net/v.js"),
    ("javascript", "https://h.com/d/e.map"),
    ("javascript", "https://h.com/j/app.min.js"),
    ("linkfinder", "https://h.com/a.png"),
    ("linkfinder", "https://h.com/base/"),
    ("linkfinder", "https://h.com/p"),
    ("linkfinder", "https://h.com/xy"),
    ("subdomains", "a.h.com"),
    ("subdomains", "api.h.com"),
    ("upload-form", "https://h.com/f"),
]


def test_golden_findings(spark, seeds):
    """Quoted links win over tags; a fragment link is the seed; comments and noise are silent.

    The static filter is about tags: a quoted image path is still a scanned link.
    """
    pages, targets = pages_of(spark, *GOLDEN), seeds("https://h.com/s#frag")
    found = materialized(discovery.findings(pages, targets))
    got = outputs(found.where("kind <> 'url'"))
    # The fragment link on the first page stands for the seed.
    assert got == sorted([*EXPECTED, ("href", "https://h.com/s")])
    assert found.where("kind = 'url'").count() == 5
    rows = {r.output: r for r in found.where("kind = 'javascript'").collect()}
    assert rows["https://cdn.net/v.js"].in_scope is False and rows["https://h.com/d/e.map"].source == "html"
    targets_out = discovery.fetch_targets(found.where("kind = 'javascript'"))
    assert {r.output for r in targets_out.collect()} == {
        "https://h.com/d/e.map", "https://h.com/j/app.min.js", "https://h.com/j/app.js"
    }
    kept = discovery.kind_filter(found, "href, AWS", "aws")
    assert {k for k, _ in outputs(kept)} == {"href"}


def test_many_seeds_take_the_shuffle_path(spark, seeds):
    pages, targets = pages_of(spark, *GOLDEN), seeds("https://h.com/s", "other.org", "h.com")
    broadcast = discovery.findings(pages, targets)
    shuffled = discovery.findings(pages, targets, limit=0)
    columns = ["seed_id", "kind", "type", "source", "output", "status", "length", "page_id"]
    a, b = (sorted(map(tuple, d.select(*columns).collect())) for d in (broadcast, shuffled))
    assert a == b and len({r[0] for r in a}) == 3


def test_strict_scope_compares_hosts(spark, seeds):
    pages = pages_of(spark, ("https://example.com/", '<a href="https://evil.com/x.example.com/">1</a>'))
    targets = seeds("example.com")
    assert outputs(discovery.findings(pages, targets, scans=("quoted",))) == [("linkfinder", "https://evil.com/x.example.com/")]
    assert outputs(discovery.findings(pages, targets, scans=("quoted",), strict=True)) == []


def test_salted_join_equals_the_broadcast_join(spark):
    from linkloom.operators.joins import lookup_join

    big = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.range(2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = (sorted(map(str, lookup_join(big, small, "k", how, limit).collect())) for limit in (0, 1 << 20))
        assert a == b


def test_statuses_lengths_and_large_bodies(spark, seeds):
    big = "x" * (5 * 1024 * 1024) + '"/late/link"'
    rows = pages_of(spark, *[(f"https://h.com/{n}", f'"/q/{n}"<a href=/t{n}>') for n in range(5)], ("https://h.com/big", big))
    statuses = F.element_at(F.array(*[F.lit(s) for s in (200, 403, 404, 500, 200, 200)]), (F.col("page_id") + 1).cast("int"))
    pages = rows.withColumn("status", statuses).withColumn("content_type", F.lit("text/html"))
    found = materialized(discovery.findings(pages, seeds("https://h.com/")))
    shown = {(r.output, r.status, r.length) for r in found.where("kind = 'url'").collect()}
    assert shown == {
        ("https://h.com/0", 200, 18), ("https://h.com/1", 403, 18), ("https://h.com/4", 200, 18), ("https://h.com/big", 200, len(big))
    }
    late = ("linkfinder", "https://h.com/late/link")
    links = [("href", f"https://h.com/t{n}") for n in (0, 4)]
    assert outputs(found.where("kind <> 'url'")) == sorted([*links, late, ("linkfinder", "https://h.com/q/0"), ("linkfinder", "https://h.com/q/4")])
    skipped = discovery.findings(pages, seeds("https://h.com/"), skip_lengths=(18,))
    assert outputs(skipped) == sorted([*links, late, ("url", "https://h.com/1"), ("url", "https://h.com/big")])
    raw = pages_of(spark, ("https://h.com/a", "a%2Fb%2Fc")).withColumn("status", F.lit(403)).withColumn("content_type", F.lit("text/html"))
    error = discovery.findings(raw, seeds("https://h.com/"), skip_lengths=(9, 5)).collect()
    assert [(r.kind, r.length) for r in error] == [("url", 9)]


def test_bodies_are_scanned_once_for_any_number_of_seeds(spark, seeds):
    pages = pages_of(spark, *[(f"https://h.com/{n}", f'"/q/{n}"') for n in range(4)])
    found = discovery.findings(pages, seeds(*[f"https://h.com/s{n}" for n in range(6)]), scans=("quoted",))
    assert outputs(found) == sorted(("linkfinder", f"https://h.com/q/{n}") for n in range(4) for _ in range(6))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "html" not in "".join(line for line in plan.splitlines() if "Join" in line or "Exchange" in line)


def test_sitemaps_stored_twice_count_once(spark):
    index = "<sitemapindex><sitemap><loc>https://h.com/a.xml</loc></sitemap></sitemapindex>"
    file = "<urlset><url><loc>https://h.com/x</loc></url></urlset>"
    rows = [(1, "https://h.com/i.xml", index), (1, "https://h.com/a.xml", file), (1, "https://h.com/a.xml", file)]
    found = ingest.sitemap_index_urls(spark.createDataFrame(rows, "seed_id long, url string, xml string"))
    assert [tuple(r) for r in found.collect()] == [(1, "https://h.com/x")]


def test_listings_are_read_to_their_end(spark):
    page = lambda n, more: '{"has_next": %s, "url_list": [{"url": "https://h.com/%d"}]}' % ("true" if more else "false", n)
    rows = [("long", n, page(n, n < 29)) for n in range(40)] + [("bad", 0, page(0, True)), ("bad", 1, "{"), ("fine", 0, page(0, False)), ("fine", 1, "{")]
    payloads = spark.createDataFrame(rows, "domain string, page int, payload string")
    found = sorted((r.domain, r.page) for r in ingest.paged_urls(payloads).collect())
    assert found == [("fine", 0)] + [("long", n) for n in range(30)]
    assert ingest.paged_urls(payloads, max_pages=10).where("domain = 'long'").count() == 10


def test_targets_and_domains(spark, seeds):
    rows = {r.raw: r for r in seeds("example.com", " https://www.example.com ", "a.dzo.com.ua", "https://example.com/x", "www.ck").collect()}
    assert (rows["example.com"].url, rows["example.com"].scope_host, rows["example.com"].scope_subs) == ("https://example.com", "example.com", True)
    www = rows[" https://www.example.com "]
    assert (www.url, www.scope_domain, www.scope_host, www.scope_subs) == ("https://www.example.com", None, "www.example.com", False)
    assert rows["a.dzo.com.ua"].scope_host == "dzo.com.ua" and rows["www.ck"].domain == "www.ck"
    assert (rows["https://example.com/x"].scope_host, rows["https://example.com/x"].scope_subs) == ("example.com", True)


def test_scope_quirks(spark, seeds):
    checks = {
        "https://a.b.example.com:8443/q": (True, True),
        "https://notexample.com/": (False, False),
        "https://evil.com/x.example.com/": (True, False),
        "https://example.com?x=1": (False, True),
        "https://u:p@a.example.com/": (True, True),
        "https://.example.com/": (False, True),
        "https://example.com": (True, True),
        "https://" + "a." * 20_000 + "b": (False, False),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(checks)], "i int, url string").crossJoin(seeds("example.com").drop("url"))
    got = df.select("i", scope.in_scope(F.col("url")).alias("a"), scope.in_scope_by_host(F.col("url")).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == list(checks.values())


def test_archive_payloads(spark):
    cdx = spark.createDataFrame([("d", '[["timestamp","original"],["2020","u1"],["x"]]'), ("e", "oops")], "domain string, payload string")
    assert [r.url for r in ingest.snapshot_urls(cdx).collect()] == ["u1"]
    lines = spark.createDataFrame([("d", '{"url":"u","timestamp":"1"}'), ("d", '{"url":"x'), ("d", '{"url":""}')], "domain string, line string")
    assert [r.url for r in ingest.index_urls(lines).collect()] == ["u"]
    page = '{"has_next":%s,"url_list":[{"url":"%s"}]}'
    paged = [("all", n, page % ("true", f"a{n}")) for n in range(12)]
    paged += [("ends", 0, page % ("true", "e0")), ("ends", 1, page % ("false", "e1")), ("ends", 2, page % ("true", "e2"))]
    paged += [("void", 0, page % ("true", "v0")), ("void", 1, "not json"), ("late", 0, page % ("false", "l0")), ("late", 1, "not json")]
    got = ingest.paged_urls(spark.createDataFrame(paged, "domain string, page int, payload string"))
    assert sorted(r.url for r in got.collect()) == sorted([f"a{n}" for n in range(12)] + ["e0", "e1", "l0"])


def test_robots_and_sitemaps(spark, seeds):
    body = "Disallow: /a\r\nallow:/b\n# Disallow: /c\nDisallow:\nUser-agent: *\nAllow: x allow: /last"
    files = spark.createDataFrame([(0, 0, body)], "seed_id long, part long, body string")
    rows = ingest.robots_urls(files, seeds("https://h.com/s/")).orderBy("line_no").collect()
    assert [r.url for r in rows] == [f"https://h.com{p}" for p in ("/a", "/b", "/c", "/s/", "/last")]
    maps = [
        (0, "https://h.com/i.xml", "<sitemapindex><sitemap><loc>https://h.com/m.xml</loc></sitemap><sitemap><loc>https://h.com/i2.xml</loc></sitemap></sitemapindex>"),
        (0, "https://h.com/i2.xml", "<sitemapindex><sitemap><loc>https://h.com/m.xml</loc></sitemap></sitemapindex>"),
        (0, "https://h.com/m.xml", '<urlset xmlns="http://x/y"><url><loc> https://h.com/1 </loc></url><url><loc></loc></url></urlset>'),
        (0, "https://h.com/bad.xml", "<urlset><url>"),
    ]
    files = spark.createDataFrame(maps, "seed_id long, url string, xml string")
    assert [r.url for r in ingest.sitemap_urls(files).collect()] == ["https://h.com/1"]
    # Both indexes are stored files; each is expanded once, and an index inside an index adds nothing.
    assert [r.url for r in ingest.sitemap_index_urls(files).collect()] == ["https://h.com/1"] * 2


def crawl_chain(spark, folder, depth, quoted=False):
    pages = ingest.read_pages(spark, folder)
    rules = fixtures.suffix_rules(spark)
    targets = materialized(scope.scope_rules(scope.normalize_targets(fixtures.host_targets(pages), rules)))
    if quoted:
        graph = frontier.page_graph(fixtures.pages_chain(pages, quoted=True))
    else:
        graph = frontier.page_graph(pages).unionByName(fixtures.chain_graph(pages))
    seeds = discovery.seed_columns(targets)
    return frontier.fetched(frontier.crawl(graph, frontier.distinct_pages(pages), seeds, depth))


def test_crawl_depth_counts(spark):
    assert [crawl_chain(spark, SMALL, d).count() for d in (1, 2, 3)] == [32, 42, 45]


def test_quoted_chain_ignores_the_depth_limit(spark):
    assert crawl_chain(spark, SMALL, 1, quoted=True).count() == 49


def test_chain_graph_is_what_chained_pages_link(spark):
    pages = ingest.read_pages(spark, SMALL)
    added = extract.link_edges(fixtures.pages_chain(pages)).where("kind = 'href'").select("page_id", "dst").distinct()
    plain = extract.link_edges(pages).where("kind = 'href'").select("page_id", "dst").distinct()
    assert sorted(added.subtract(plain).collect()) == sorted(fixtures.chain_graph(pages).select("page_id", "dst").collect())


def test_render_pick(spark, seeds):
    rows = [(n, f"https://h.com/{n}", "text/html", 100, 200) for n in range(10)] + [(10, "https://h.com/s", "text/html", 5, 200)]
    rows += [(-1, "https://h.com/gone", "text/html", 100, 404)]
    pages = spark.createDataFrame(rows, "page_id long, url string, content_type string, raw_length int, status int").withColumn("seed_id", F.lit(0).cast("long"))
    picked = frontier.render_candidates(pages, seeds("https://h.com/s")).orderBy("pick").collect()
    assert [r.url for r in picked] == ["https://h.com/s"] + [f"https://h.com/{n}" for n in range(5)]


def test_findings_are_appended_per_host(spark):
    rows = [("[href] - https://a.com/1", "a_com"), ("[href] - https://b.com/1", "b_com")]
    lines = spark.createDataFrame(rows, "line string, host_key string")
    path = scratch_path(spark, "sink-test")
    sinks.write_by_host(lines, path)
    sinks.write_by_host(lines, path)
    back = spark.read.schema("line string, host_key string").text(path)
    assert back.groupBy("host_key").count().where("count = 2").count() == 2


def test_raw_link_counts(spark):
    """Quoted-link matches in the stored pages before any filter."""
    from linkloom.functions import patterns

    pages = ingest.read_pages(spark, MEDIUM)
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(patterns.QUOTED_LINK), F.lit(1))))
    assert found.count() == 1311


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_scripts_that_are_not_wanted_give_no_token(spark, seeds, limit):
    """Scripts meet the wanted ones as one row each; to leave them out again as findings costs every step before."""
    scripts = pages_of(spark, *[(f"https://h.com/js/{i}.js", f"'/a/{i}' '/both'") for i in range(4)])
    targets = seeds("https://h.com/", "https://other.org/")
    wanted = spark.createDataFrame([(0, "https://h.com/js/2.js"), (1, "https://h.com/js/3.js")], "seed_id long, url string")
    found = discovery.raw_findings(scripts, targets, scripts=True, wanted=wanted, limit=limit)
    assert outputs(found.where("kind = 'linkfinder'")) == [("linkfinder", f"https://h.com{p}") for p in ("/a/2", "/both")]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = max(i for i, line in enumerate(plan) if "LeftSemi, ((seed_id" in line)
    assert joined > next(i for i, line in enumerate(plan) if "Generate inline(_found" in line)


def test_bodies_beyond_the_words_limit_are_scanned_whole(spark, seeds, monkeypatch):
    pages = pages_of(spark, *GOLDEN)
    targets = seeds("https://h.com/", "https://other.org/")
    found = [outputs(discovery.findings(pages, targets))]
    monkeypatch.setattr(extract, "MAX_WORDS_BYTES", 0)
    found.append(outputs(discovery.findings(pages, targets)))
    assert found[0] == found[1] and ("aws", "bk.s3.amazonaws.com") in found[0]
