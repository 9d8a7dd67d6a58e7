"""Crawl rounds on small graphs, their plans, and the union of all producers."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import frontier, scope
from linkloom.plans import discovery
from linkloom.session import materialized


@pytest.fixture
def seeds(spark):
    def build(*targets, **options):
        rules = spark.createDataFrame([(r,) for r in ("com", "org", "net")], "rule string")
        raw = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "seed_id long, raw string")
        return materialized(scope.scope_rules(scope.normalize_targets(raw, rules), **options))

    return build


def stored(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


PAGES = [
    ("https://h.com/", "<a href=/a>a</a><a href=/private/x>p</a><script src='/js/app.min.js'></script><script src='https://cdn.net/v.js'></script>"),
    ("https://h.com/a", "<a href=/a/deep>d</a><a href=/Case>1</a>"),
    ("https://h.com/a/deep", "<a href=/a/deeper>d</a>"),
    ("https://h.com/hidden", "<a href=/behind>b</a><a href=/CASE>2</a>"),
    ("https://h.com/from-script", "<a href=/last>l</a>"),
    ("https://h.com/private/x", "<a href=/never>n</a>"),
    ("https://cdn.net/v.js", "<a href=https://h.com/no>n</a>"),
]
SCRIPTS = [
    ("https://h.com/js/app.js", "go('/from-script'); load('./more/lib.js')"),
    ("https://h.com/js/more/lib.js", "go('/from-lib')"),
    ("https://cdn.net/v.js", "go('https://h.com/off-scope-script')"),
]


def rounds(spark, seeds, depth=0, starts=(), **options):
    pages, scripts = stored(spark, *PAGES), stored(spark, *SCRIPTS)
    listed = spark.createDataFrame([(0, u) for u in starts], "seed_id long, url string")
    visits = frontier.crawl(
        frontier.site_graph(pages, scripts), frontier.distinct_pages(pages), discovery.seed_columns(seeds("https://h.com/")), depth, starts=listed, **options
    )
    return {(r.url.removeprefix("https://h.com"), r.scripted): r["round"] for r in visits.collect()}


def test_rounds_go_through_scripts(spark, seeds):
    found = rounds(spark, seeds, exclude="/private/")
    assert found == {
        ("/", False): 1,
        ("/a", False): 2,
        ("/js/app.min.js", True): 2,
        ("/js/app.js", True): 2,
        ("/a/deep", False): 3,
        ("/Case", False): 3,
        ("/from-script", False): 3,
        ("/js/more/lib.js", True): 3,
        ("/a/deeper", False): 4,
        ("/last", False): 4,
        ("/from-lib", False): 4,
    }


def test_urls_that_only_a_seeder_knows(spark, seeds):
    starts = ["https://h.com/hidden#part", "https://h.com/private/y", "https://h.com/logo.png", "https://other.org/", "https://h.com/a", "https://h.com/hidden"]
    found = rounds(spark, seeds, exclude="/private/", starts=starts)
    # Canonical, once, in the first round; neither excluded, static nor out of scope.
    assert sorted(k[0] for k, n in found.items() if n == 1) == ["/", "/a", "/hidden"]
    assert found["/behind", False] == 2 and found["/a/deep", False] == 2
    # Spellings are one claim: /Case and /CASE meet in one round, and the page with the smaller id is first.
    assert ("/Case", False) in found and ("/CASE", False) not in found


def test_depth_counts_tag_links_only(spark, seeds):
    """At depth 1 no tag link is followed, but a link in a script starts over."""
    found = rounds(spark, seeds, depth=1, exclude="/private/")
    assert sorted(found) == [("/", False), ("/from-lib", False), ("/from-script", False), ("/js/app.js", True), ("/js/app.min.js", True), ("/js/more/lib.js", True)]
    assert rounds(spark, seeds, depth=1, max_rounds=1) == {("/", False): 1}


def above(plan, mark):
    """Operators above the line of a plan that holds ``mark``, by indentation."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < level:
            out.append(line)
            level = depth(line)
    return out


def test_neither_graph_nor_claims_are_shuffled_again(spark, seeds, monkeypatch):
    monkeypatch.setattr(frontier, "POINTS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = frontier.Tables(spark)
    try:
        links = spark.range(2000).selectExpr(
            "concat('https://h.com/', id) src", "false scripted", "concat('https://h.com/', id + 1) dst", "concat('https://h.com/', id + 1) key",
            "'href' kind", "1 phase", "id page_id", "cast(0 as int) ord",
        )
        graph = tables.write(links, "graph", ["src"])
        state = discovery.seed_columns(seeds("https://h.com/")).withColumns({"url": F.lit("https://h.com/7"), "scripted": F.lit(False), "depth": F.lit(1), "round": F.lit(1)})
        start = state.select("seed_id", "url", "scripted", "depth", "round", "seed_canon", *scope.SCOPE_COLUMNS)
        claimed = tables.write(frontier.claims(graph, start, None).withColumn("round", F.lit(2)), "claimed", frontier.CLAIM, "round")
        again = frontier.claims(graph, claimed.withColumn("scripted", F.lit(False)).select(*start.columns), claimed)
        plan = again._jdf.queryExecution().executedPlan().toString()
        for name in ("graph/", "graph]"):
            if name in plan:
                assert not any("Exchange" in line for line in above(plan, name)[: [("Join" in x) for x in above(plan, name)].index(True) + 1])
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "Bucketed: true" in line]
        assert len(scans) >= 2, plan
        # One exchange for the delta by URL, one for its aggregate by key; the scan of the last round is the delta itself.
        assert plan.count("Exchange hashpartitioning") == 2, plan
        assert [r.url for r in again.collect()] == ["https://h.com/9"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        tables.forget()


def test_no_table_name_stays_in_the_catalog(spark, seeds):
    rounds(spark, seeds)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("crawl_")]


def test_union_of_all_producers(spark, seeds):
    pages, scripts = stored(spark, *PAGES), stored(spark, *SCRIPTS)
    log = spark.createDataFrame(
        [(0, 1, "https://h.com/a", "XHR", "https://h.com/api?q=1"), (0, 2, "https://h.com/a", "Fetch", "https://h.com/API?q=1"), (0, 1, "https://h.com/a", "XHR", "https://h.com/a/deep"),
         (0, 1, "https://h.com/a", "Image", "https://h.com/i"), (0, 1, "https://h.com/a", "XHR", "https://other.org/x"), (0, 1, "https://h.com/a", "Fetch", "https://h.com/from-lib")],
        "seed_id long, page_id long, page_url string, resource_type string, request_url string",
    )
    listed = {"robots": spark.createDataFrame([(0, "https://h.com/r")] * 2, "seed_id long, url string")}
    shown = spark.createDataFrame([(0, "https://h.com/")], "seed_id long, url string")
    found = discovery.whole_findings(pages, seeds("https://h.com/"), scripts, log, listed, shown)
    rows = sorted((r.kind, r.output.removeprefix("https://h.com")) for r in found.where("kind not in ('url')").collect())
    # A request that a page links to stays href; one that only a script names is a request, since it came first.
    assert [r for r in rows if r[0] == "network"] == [("network", "/api?q=1"), ("network", "/from-lib")]
    assert ("href", "/a/deep") in rows and ("linkfinder", "/from-script") in rows and ("linkfinder", "/from-lib") not in rows
    assert [r for r in rows if r[0] in ("robots", "render")] == [("render", "/"), ("robots", "/r"), ("robots", "/r")]
    # Scripts that only scripts name are found, fetched and reported as responses.
    assert ("javascript", "/js/more/lib.js") in rows
    responses = {r.output for r in found.where("kind = 'url'").collect()}
    assert {"https://h.com/js/app.js", "https://h.com/js/more/lib.js"} <= responses


def test_union_without_scripts_is_the_page_findings(spark, seeds):
    pages, own = stored(spark, *PAGES), seeds("https://h.com/")
    columns = ["seed_id", "kind", "input", "source", "type", "output", "status", "length"]
    a, b = (sorted(map(str, x.select(*columns).collect())) for x in (discovery.whole_findings(pages, own), discovery.findings(pages, own)))
    assert a == b and a


LITERALS = {
    "/en/": "/en/", r"/(en|fr)/": "/", r"\.h\.com/a+b": ".h.com/a", "a|b": "", "(?i)admin": "", "ab?cd": "cd", "x{2}yz": "yz", r"^https://h\d+\.com$": "https://h",
    "[ab]cde": "cde", r"a\pLb": "", "a.*long-part.*b": "long-part", "(abc)": "", "ab*": "a", "a[^/]+/x": "/x", r"q\Qa.b\E": "", "no+w": "no",
}


def test_literals_that_every_match_contains():
    from linkloom.operators.scope import required_literal

    assert {p: required_literal(p) for p in LITERALS} == LITERALS


def test_include_pattern_holds_on_every_host(spark, seeds):
    pages = stored(spark, ("https://h.com/", "<a href=/fr/x>n</a>"), ("https://other.org/en/b", "<a href=/en/c>c</a><a href=/d>d</a>"), ("https://h.com/en", "<a href=/en/e>e</a>"))
    own = seeds("https://h.com/", include="/en/")
    found = discovery.findings(pages, own, anywhere=True).where("kind in ('url', 'href')")
    assert sorted((r.kind, r.output) for r in found.collect()) == [("href", "https://other.org/en/c"), ("url", "https://other.org/en/b")]


def test_many_patterns_meet_urls_by_their_literals(spark):
    rows = spark.createDataFrame([(i, f"https://h{i}.com/part{i % 50}x/") for i in range(200)], "page_id long, url string")
    held = [(i, None, False, f"/part{i}x/") for i in range(1000)] + [(5000, None, False, r"h\d+\.net"), (5001, None, False, "(?i)H7[.]COM"), (5002, "h9.com", False, None)]
    own = spark.createDataFrame(held, "seed_id long, scope_host string, scope_subs boolean, scope_re string")
    met = scope.attach_by_pattern(rows, own)
    assert sorted((r.page_id, r.seed_id) for r in met.collect()) == sorted([(i, i % 50) for i in range(200)] + [(7, 5001)])
    assert "CartesianProduct" not in met._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_pages_of_uncovered_hosts_are_not_scanned(spark, seeds):
    pages = stored(spark, ("https://h.com/", "a"), ("https://www.h.com/", "b"), ("https://other.org/", "c"), ("not a url", "d"))
    kept, _ = discovery._covered(pages, discovery.seed_columns(seeds("h.com")), 1 << 26)
    assert sorted(r.url for r in kept.collect()) == ["https://h.com/", "https://www.h.com/"]
    columns = ["seed_id", "kind", "output"]
    small, large = (sorted(map(tuple, discovery.findings(pages, seeds("h.com"), limit=n).select(*columns).collect())) for n in (1 << 26, -1))
    assert small == large and small


def linked(spark, rows):
    """Graph rows from (src, dst, kind, page_id, ord), the pages of one host."""
    rows = [(f"https://h.com/{a}", f"https://h.com/{b}", kind, int(kind == "href"), page, at) for a, b, kind, page, at in rows]
    return spark.createDataFrame(rows, "src string, dst string, kind string, phase int, page_id long, ord int")


def walked(spark, seeds, graph, depth=0, **options):
    known = graph.select(F.col("src").alias("canonical"), "page_id").distinct()
    visits = frontier.crawl(graph, known, discovery.seed_columns(seeds("https://h.com/0", "h.com")), depth, **options)
    return sorted((r.seed_id, r.url, r.depth, r["round"]) for r in visits.collect())


def test_long_paths_take_no_round_for_each_link(spark, seeds, monkeypatch):
    """200 pages with links to the next and the one before, stored last page first, and links that no page stands behind."""
    calls, claims = [], frontier.claims
    monkeypatch.setattr(frontier, "claims", lambda *a: calls.append(1) or claims(*a))
    rows = [(i, i + 1, "href", 1000 - i, 0) for i in range(200)] + [(i, i - 1, "href", 1000 - i, 1) for i in range(1, 200)]
    rows += [(i, f"leaf{i}", "href", 1000 - i, 2) for i in range(0, 200, 7)]
    found = [r for r in walked(spark, seeds, linked(spark, rows)) if r[0] == 0]
    expected = [(0, f"https://h.com/{i}", i + 1, i + 1) for i in range(201)] + [(0, f"https://h.com/leaf{i}", i + 2, i + 2) for i in range(0, 200, 7)]
    assert found == sorted(expected)
    assert len(calls) < 20


def test_rounds_worked_out_at_once_are_those_one_by_one(spark, seeds, monkeypatch):
    """Spellings of one key, links back, quoted links and shortcuts."""
    import random

    draw = random.Random(5)
    name = lambda: draw.choice(["p{}", "P{}", "p{}", "p{}x"]).format(draw.randrange(14))
    rows = [(0, "p0", "href", 0, 0)] + [(f"p{i}", f"p{i + 1}", "href", i, 0) for i in range(14)]
    rows += [(name(), name(), draw.choice(["href", "href", "linkfinder"]), draw.randrange(200), n) for n in range(9)]
    graph, sides = materialized(linked(spark, rows)), []
    for steady in (1, 1000):
        monkeypatch.setattr(frontier, "STEADY", steady)
        sides.append(walked(spark, seeds, graph))
    assert sides[0] == sides[1] and max(r[3] for r in sides[0]) > 5
