"""Registered queries: each takes a session and a folder of tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns, text, urls
from ..operators import dedup, extract, frontier, joins, reports, scope, sinks
from ..session import materialized, scratch_path
from ..sources import fixtures, ingest
from ..streaming import jobs as streams
from . import discovery

# Arguments of the parameterised queries.
SKIPPED_LENGTHS = tuple(range(1000, 2000))
SMALL_SCAN = 4096
EXCLUDED = r"/(the|and|la|de)[a-z]*\z"
EXCLUDED_ANY_CASE = "(?i)" + EXCLUDED  # so that all spellings of a URL, which are one claim, fare alike
INCLUDED = r"/(en|fr)/"
INCLUDED_DOMAIN = "spam-farm.example.org"
CRAWL_DEPTH = 4


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.read_pages(spark, folder)


def _scoped(pages: DataFrame, targets: DataFrame, **options) -> DataFrame:
    rules = fixtures.suffix_rules(pages.sparkSession)
    return materialized(scope.scope_rules(scope.normalize_targets(targets, rules), **options))


def _host_seeds(pages: DataFrame) -> DataFrame:
    return _scoped(pages, fixtures.host_targets(pages))


def _apex_seeds(pages: DataFrame) -> DataFrame:
    return _scoped(pages, fixtures.apex_targets(pages))


def _with_seed(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach the host seed to files keyed by host."""
    hosts = fixtures.with_host(fixtures.host_targets(pages).withColumnRenamed("raw", "url")).select("seed_id", "host")
    return joins.lookup_join(files, hosts, "host").drop("host")


def _rich_findings(spark, folder, **options) -> DataFrame:
    pages = _pages(spark, folder)
    return discovery.findings(fixtures.pages_rich(pages), _host_seeds(pages), **options)


# Sources


def load_targets(spark, folder):
    pages = _pages(spark, folder)
    blank = pages.select(F.col("page_id").alias("seed_id"), F.lit(" \t").alias("raw"))
    return ingest.load_targets(fixtures.mixed_targets(pages), fixtures.host_targets(pages), blank)


def normalize_targets(spark, folder):
    targets = ingest.load_targets(fixtures.mixed_targets(_pages(spark, folder)))
    seeds = scope.normalize_targets(targets, fixtures.suffix_rules(spark))
    return seeds.select("seed_id", "url", "host", "domain", "scope_domain", "allow_subs")


def scan_pages(spark, folder):
    return _pages(spark, folder).select("page_id", "url", F.octet_length("html").alias("bytes"))


def wayback_urls(spark, folder):
    return ingest.snapshot_urls(fixtures.archive_cdx(_pages(spark, folder)))


def commoncrawl_urls(spark, folder):
    return ingest.index_urls(fixtures.archive_lines(_pages(spark, folder)))


def latest_index(spark, folder):
    return ingest.latest_index(fixtures.index_lists(_pages(spark, folder)))


def report_urls(spark, folder):
    return ingest.report_urls(fixtures.archive_report(_pages(spark, folder)))


def paged_urls(spark, folder):
    return ingest.paged_urls(fixtures.archive_paged(_pages(spark, folder)))


def robots_urls(spark, folder):
    pages = _pages(spark, folder)
    files = _with_seed(fixtures.robots(pages), pages)
    return ingest.robots_urls(files, _host_seeds(pages))


def sitemap_urls(spark, folder):
    pages = _pages(spark, folder)
    return ingest.sitemap_urls(_with_seed(fixtures.sitemaps(pages), pages))


def sitemap_index_urls(spark, folder):
    pages = _pages(spark, folder)
    return ingest.sitemap_index_urls(_with_seed(fixtures.sitemaps(pages), pages))


def wellknown_candidates(spark, folder):
    return ingest.wellknown_candidates(_host_seeds(_pages(spark, folder)))


def archive_union(spark, folder):
    pages = _pages(spark, folder)
    seeds = _apex_seeds(pages).withColumn("archive_domain", F.col("host"))
    return ingest.archive_union(
        seeds,
        ingest.snapshot_urls(fixtures.archive_cdx(pages)),
        ingest.index_urls(fixtures.archive_lines(pages)),
        ingest.report_urls(fixtures.archive_report(pages)),
        ingest.paged_urls(fixtures.archive_paged(pages)),
    )


def archive_host_match(spark, folder):
    rows = fixtures.with_host(_pages(spark, folder).select("page_id", "url"))
    rows = rows.select("page_id", "url", F.regexp_replace("host", r"^(?:blog|m|www)\.", "").alias("domain"))
    exact = ingest.archive_host_match(rows, False).withColumn("mode", F.lit("host"))
    return exact.unionByName(ingest.archive_host_match(rows, True).withColumn("mode", F.lit("domain")))


def network_urls(spark, folder):
    pages = _pages(spark, folder)
    seeds = _host_seeds(pages)
    return ingest.network_urls(fixtures.network_log(pages, seeds), seeds)


# Sinks


def findings_json(spark, folder):
    return sinks.formatted(_rich_findings(spark, folder), "json").select("seed_id", "line")


def findings_text(spark, folder):
    return sinks.formatted(_rich_findings(spark, folder), with_length=True).select("seed_id", "line")


def findings_quiet(spark, folder):
    return sinks.formatted(_rich_findings(spark, folder), "quiet").select("seed_id", "line")


def findings_by_host(spark, folder):
    lines = sinks.formatted(_rich_findings(spark, folder))
    lines = lines.withColumn("host_key", sinks.host_key(urls.url_host(F.col("input"))))
    path = scratch_path(spark, "by-host")
    sinks.append_by_host(lines, path, "first")
    return sinks.read_by_host(spark, path).groupBy("host_key").agg(F.count(F.lit(1)).alias("lines"))


def raw_bodies(spark, folder):
    pages = _pages(spark, folder)
    bodies = sinks.raw_bodies(discovery.in_scope_bodies(pages, _host_seeds(pages)))
    return bodies.select("seed_id", "page_id", "line")


# Filters


def scope_filter(spark, folder):
    pages = _pages(spark, folder)
    edges = extract.link_edges(fixtures.pages_rich(pages)).where("dst is not null")
    edges = edges.withColumn("host", urls.url_host(F.col("src"))).select("page_id", "host", "link")
    parts = []
    for mode, seeds in (("host", _host_seeds(pages)), ("apex", _apex_seeds(pages))):
        kept = scope.attach_seeds(edges, seeds).where(scope.in_scope(F.col("link")))
        parts.append(kept.select("seed_id", "page_id", "link", F.lit(mode).alias("mode")))
    return parts[0].unionByName(parts[1])


def scope_rules(spark, folder):
    pages = _pages(spark, folder)
    seeds = _scoped(pages, fixtures.mixed_targets(pages))
    return seeds.select("seed_id", "scope_host", "scope_subs")


def include_filter(spark, folder):
    pages = _pages(spark, folder)
    targets = fixtures.apex_targets(pages)
    rows = pages.select("page_id", "url").withColumn("host", urls.url_host(F.col("url")))
    parts = []
    for mode, options in (
        ("include", {"include": INCLUDED}),
        ("domain", {"include": INCLUDED, "include_domain": INCLUDED_DOMAIN}),
    ):
        kept = scope.attach_seeds(rows, _scoped(pages, targets, **options)).where(scope.in_scope(F.col("url")))
        parts.append(kept.select("seed_id", "page_id", F.lit(mode).alias("mode")))
    either = scope.asset_in_scope(F.col("url"), INCLUDED, INCLUDED_DOMAIN)
    assets = scope.attach_seeds(rows, _scoped(pages, targets)).where(either)
    parts.append(assets.select("seed_id", "page_id", F.lit("assets").alias("mode")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def include_anywhere(spark, folder):
    """Findings of seeds whose scope is a pattern, on all hosts that it matches."""
    pages = _pages(spark, folder)
    seeds = _scoped(pages, fixtures.apex_targets(pages), include=INCLUDED)
    found = discovery.findings(fixtures.pages_rich(pages), seeds, anywhere=True, scans=("response", "quoted", "tag"))
    return found.where("kind in ('url', 'href', 'linkfinder')").select("seed_id", "kind", "output")


def exclude_filter(spark, folder):
    edges = extract.link_edges(_pages(spark, folder))
    return edges.where(~F.col("dst").rlike(EXCLUDED)).select("page_id", "dst")


def static_asset_filter(spark, folder):
    rich = fixtures.pages_rich(_pages(spark, folder))
    rows = extract.resolve(extract.scan(extract.responses(rich), ("tag",))).where("resolved is not null")
    kept = rows.where(~F.col("resolved").rlike(patterns.STATIC_ASSET))
    return kept.select("page_id", F.col("resolved").alias("link"))


def kind_filter(spark, folder):
    found = discovery.kind_filter(_rich_findings(spark, folder), " HREF,javascript, aws", "AWS")
    return found.select("seed_id", "kind", "output")


def length_filter(spark, folder):
    pages = _pages(spark, folder)
    scans = ("response", "quoted", "tag")
    found = discovery.findings(pages, _host_seeds(pages), scans=scans, skip_lengths=SKIPPED_LENGTHS)
    return found.select("seed_id", "kind", "output")


def body_cap(spark, folder):
    rows = extract.responses(_pages(spark, folder), SMALL_SCAN)
    return rows.select("page_id", "length", F.col("decoded").isNotNull().alias("scanned"))


def error_status_filter(spark, folder):
    rows = fixtures.pages_meta(_pages(spark, folder))
    status = F.col("status")
    return rows.where(~extract.is_success(status) & extract.reported_error(status)).select("page_id", "url", "status")


def asset_status_filter(spark, folder):
    rows = fixtures.pages_meta(_pages(spark, folder))
    return rows.where(extract.scanned_asset(F.col("status"))).select("page_id", "url", "status")


def content_type_gate(spark, folder):
    rows = fixtures.pages_meta(_pages(spark, folder))
    return rows.where(extract.may_hold_links(F.col("content_type"))).select("page_id", "content_type")


def _quoted_tokens(pages: DataFrame) -> DataFrame:
    return extract.scan(extract.responses(pages), ("quoted",)).select("page_id", "url", "base", "scan", "token")


def noise_filter(spark, folder):
    rows = _quoted_tokens(_pages(spark, folder))
    digit = F.col("page_id") % 6
    token = (
        F.when(digit == 0, F.concat(F.lit("text/"), F.regexp_replace("token", "[^a-z]", "")))
        .when(digit == 1, F.concat(F.lit("{{"), "token", F.lit("}}")))
        .when(digit == 2, F.concat("token", F.lit("/:id")))
        .when(digit == 3, F.concat(F.lit("1/"), (F.col("page_id") % 31).cast("string"), F.lit("/2025")))
        .otherwise(F.col("token"))
    )
    rows = urls.pinned(rows.withColumn("token", token), "token")
    return rows.where(~text.is_noise(F.col("token"))).select("page_id", "token")


def absolute_links(spark, folder):
    pages = _pages(spark, folder)
    own = F.concat("html", F.lit('<a href="'), "url", F.lit('">self</a>'))
    rows = extract.resolve(_quoted_tokens(pages.withColumn("html", own)))
    return rows.select("page_id", "token", F.col("resolved_absolute").alias("absolute"))


def asset_inventory(spark, folder):
    found = _rich_findings(spark, folder, scans=("quoted", "tag")).where("kind = 'javascript'")
    return found.select("seed_id", "output", urls.extension(F.col("output")).alias("ext"))


def redirect_scope(spark, folder):
    rows = fixtures.redirects(_pages(spark, folder))
    subs = F.col("page_id") % 8 == 0
    kept = rows.where(scope.redirect_allowed(F.col("target_url"), F.col("base_host"), subs))
    return kept.select("page_id", "base_host", "target_url")


def in_scope_pages(spark, folder):
    pages = _pages(spark, folder)
    return discovery.in_scope_bodies(pages, _host_seeds(pages)).select("seed_id", "page_id", "url")


def in_scope_responses(spark, folder):
    """As in_scope_pages, where statuses and lengths leave responses out as well."""
    pages = _pages(spark, folder)
    rows = discovery.in_scope_bodies(fixtures.pages_meta(pages), _host_seeds(pages), SKIPPED_LENGTHS)
    return rows.select("seed_id", "page_id", "url", "length")


# Extraction


def href_links(spark, folder):
    found = _rich_findings(spark, folder, scans=("tag",)).where("kind = 'href'")
    return found.select("seed_id", "output", "page_id")


def script_assets(spark, folder):
    found = _rich_findings(spark, folder, scans=("tag",)).where("kind = 'javascript'")
    return found.select("seed_id", "output", F.col("in_scope").alias("crawlable"))


def form_pages(spark, folder):
    return _rich_findings(spark, folder, scans=("tag",)).where("kind = 'form'").select("seed_id", "output")


def upload_form_pages(spark, folder):
    return _rich_findings(spark, folder, scans=("tag",)).where("kind = 'upload-form'").select("seed_id", "output")


def quoted_links(spark, folder):
    pages = _pages(spark, folder)
    found = discovery.findings(pages, _host_seeds(pages), scans=("quoted",)).where("kind = 'linkfinder'")
    return found.select("seed_id", "source", "output")


def _asset_findings(spark, folder):
    pages = _pages(spark, folder)
    seeds = _host_seeds(pages)
    rich = fixtures.pages_rich(pages)
    assets = discovery.findings(rich, seeds, scans=("tag",)).where("kind = 'javascript'")
    return discovery.asset_findings(assets, fixtures.script_bodies(pages), seeds, scans=("quoted",))


def asset_quoted_links(spark, folder):
    return _asset_findings(spark, folder).select("seed_id", "kind", "source", "output")


def asset_quoted_links_whole(spark, folder):
    """As asset_quoted_links, with a script for every page, so that every body is scanned."""
    pages = _pages(spark, folder)
    seeds = _host_seeds(pages)
    linked = fixtures.pages_own_script(pages)
    assets = discovery.findings(linked, seeds, scans=("tag",)).where("kind = 'javascript'")
    found = discovery.asset_findings(assets, fixtures.page_scripts(pages), seeds, scans=("quoted",))
    return found.select("seed_id", "kind", "source", "output")


def asset_feed(spark, folder):
    found = _rich_findings(spark, folder, scans=("quoted", "tag")).where("kind = 'javascript'")
    return discovery.fetch_targets(found).select("seed_id", "type", F.col("output").alias("url"))


def unminified_variants(spark, folder):
    found = _rich_findings(spark, folder, scans=("quoted", "tag")).where("kind = 'javascript' and in_scope")
    return extract.unminified(found).select("seed_id", F.col("output").alias("url"))


def _rich_apex(spark, folder, scan):
    pages = _pages(spark, folder)
    return discovery.findings(fixtures.pages_rich(pages), _apex_seeds(pages), scans=(scan,))


def subdomains(spark, folder):
    return _rich_apex(spark, folder, "host").select("seed_id", "output", "page_id")


def s3_buckets(spark, folder):
    return _rich_apex(spark, folder, "bucket").select("seed_id", "output")


def url_findings(spark, folder):
    pages = _pages(spark, folder)
    found = discovery.findings(fixtures.pages_meta(pages), _host_seeds(pages), scans=("response",))
    return found.select("seed_id", "page_id", "output", "status", "length")


def link_edges(spark, folder):
    edges = extract.link_edges(fixtures.pages_rich(_pages(spark, folder)))
    return edges.select("page_id", "src", "dst", "kind", "phase")


# De-duplication, joins, union


def seen_dedup(spark, folder):
    return _rich_findings(spark, folder, scans=("quoted", "tag")).select("seed_id", "set_name", "key", "kind", "page_id")


def exact_unique(spark, folder):
    return dedup.exact_unique(extract.link_edges(_pages(spark, folder)), "src", "link")


def kind_precedence(spark, folder):
    pages = _pages(spark, folder)
    found = discovery.findings(pages, _host_seeds(pages), scans=("quoted", "tag")).where("set_name = 'link'")
    return found.groupBy("seed_id", "kind").agg(F.count(F.lit(1)).alias("urls"))


def canonical_dedup(spark, folder):
    return dedup.canonical_groups(_pages(spark, folder))


def new_frontier(spark, folder):
    pages = _pages(spark, folder)
    links = discovery.findings(fixtures.pages_rich(pages), _host_seeds(pages), scans=("quoted", "tag"))
    links = links.where("set_name = 'link'").select("seed_id", F.col("output").alias("url"))
    return dedup.unseen(links, _visited(pages), ["seed_id", "url"])


def _visited(pages: DataFrame) -> DataFrame:
    """Stored pages as fetched URLs of their host seed."""
    rows = urls.with_canonical(pages.select("page_id", "url"), "url").where("canonical is not null")
    rows = rows.withColumn("host", urls.url_host(F.col("url")))
    return scope.attach_seeds(rows, _host_seeds(pages)).select("seed_id", F.col("canonical").alias("url"))


def registrable_domain(spark, folder):
    hosts = fixtures.with_host(_pages(spark, folder).select("page_id", "url")).select("host")
    label = F.regexp_extract("host", r"^([^.]+)", 1)
    more = F.array(
        F.col("host"),
        F.concat(F.lit("a."), label, F.lit(".com.ua")),
        F.concat(F.lit("a."), label, F.lit(".x.ck")),
        F.concat(label, F.lit(".www.ck")),
        F.concat(label, F.lit(".ck")),
        F.concat(F.lit("a."), label, F.lit(".unlisted")),
        F.lit("com"),
    )
    wide = hosts.select(F.explode(more).alias("host")).distinct()
    return scope.with_registrable_domain(wide, "host", fixtures.suffix_rules(spark))


def pages_by_seed(spark, folder):
    pages = _pages(spark, folder)
    rows = pages.select("page_id", "url").withColumn("host", urls.url_host(F.col("url")))
    parts = []
    for mode, seeds in (("host", _host_seeds(pages)), ("apex", _apex_seeds(pages))):
        kept = scope.attach_seeds(rows, seeds).where(scope.in_scope(F.col("url")))
        parts.append(kept.select("seed_id", "page_id", F.lit(mode).alias("mode")))
    return parts[0].unionByName(parts[1])


def frontier_fetch(spark, folder):
    pages = _pages(spark, folder)
    wanted = fixtures.chain_graph(pages).select(F.col("dst").alias("canonical")).distinct()
    return frontier.distinct_pages(pages).join(wanted, "canonical").select("canonical", "page_id")


def all_findings(spark, folder):
    found = _rich_findings(spark, folder)
    return found.select("seed_id", "kind", "input", "source", "type", "output", "status", "length")


def _listed(pages: DataFrame, seeds: DataFrame) -> dict[str, DataFrame]:
    """URLs of robots files, sitemaps and archives by the kind of finding that they are."""
    maps = _with_seed(fixtures.sitemaps(pages), pages)
    archives = ingest.archive_union(
        seeds.withColumn("archive_domain", F.col("domain")),
        ingest.snapshot_urls(fixtures.archive_cdx(pages)),
        ingest.index_urls(fixtures.archive_lines(pages)),
        ingest.report_urls(fixtures.archive_report(pages)),
        ingest.paged_urls(fixtures.archive_paged(pages)),
    )
    return {
        "robots": ingest.robots_urls(_with_seed(fixtures.robots(pages), pages), seeds).select("seed_id", "url"),
        "sitemap": ingest.sitemap_urls(maps).select("seed_id", "url").unionByName(ingest.sitemap_index_urls(maps).select("seed_id", "url")),
        "other-sources": archives.select("seed_id", "url"),
    }


def _whole_findings(spark, folder) -> DataFrame:
    pages = _pages(spark, folder)
    seeds = _host_seeds(pages)
    rich = fixtures.pages_own_script(fixtures.pages_rich(pages))
    shown = rich.select("page_id", "url", urls.url_host(F.col("url")).alias("host"), F.octet_length("html").alias("raw_length"))
    shown = shown.withColumns({"status": F.lit(200), "content_type": F.lit("text/html")})
    shown = scope.attach_seeds(shown, seeds).where(scope.in_scope(F.col("url")))
    return discovery.whole_findings(
        rich, seeds, fixtures.page_scripts(pages), fixtures.network_log(pages, seeds), _listed(pages, seeds), frontier.render_candidates(shown, seeds)
    )


def all_findings_whole(spark, folder):
    """Findings of all producers: pages, scripts, rendered pages, robots files, sitemaps and archives."""
    found = _whole_findings(spark, folder)
    return found.select("seed_id", "kind", "input", "source", "type", "output", "status", "length")


# Iteration


def _crawl(spark, folder, depth=CRAWL_DEPTH) -> DataFrame:
    pages = _pages(spark, folder)
    graph = frontier.page_graph(pages).unionByName(fixtures.chain_graph(pages))
    seeds = discovery.seed_columns(_host_seeds(pages))
    return frontier.crawl(graph, frontier.distinct_pages(pages), seeds, depth)


def crawl_frontier(spark, folder):
    return frontier.fetched(_crawl(spark, folder)).select("seed_id", "page_id", "url", "depth")


def crawl_unlimited(spark, folder):
    return frontier.fetched(_crawl(spark, folder, 0)).select("seed_id", "page_id", "url")


def crawl_depths(spark, folder):
    key = dedup.seen_key(F.col("url")).alias("url_key")
    return _crawl(spark, folder).groupBy("seed_id", key).agg(F.min("round").alias("round"))


def crawl_depths_unlimited(spark, folder):
    key = dedup.seen_key(F.col("url")).alias("url_key")
    return _crawl(spark, folder, 0).groupBy("seed_id", key).agg(F.min("round").alias("round"))


def crawl_seeded(spark, folder):
    """Rounds that start from robots files, sitemaps, archives and requests too, and go through script bodies."""
    pages = _pages(spark, folder)
    seeds = _host_seeds(pages)
    graph = frontier.site_graph(fixtures.pages_own_script(pages), fixtures.page_scripts(pages))
    starts = ingest.network_urls(fixtures.network_log(pages, seeds), seeds)
    for rows in _listed(pages, seeds).values():
        starts = starts.unionByName(rows)
    known = frontier.distinct_pages(pages)
    visits = frontier.crawl(graph, known, discovery.seed_columns(seeds), exclude=EXCLUDED_ANY_CASE, starts=starts)
    key = dedup.seen_key(F.col("url")).alias("url_key")
    return visits.groupBy("seed_id", key, "scripted").agg(F.min("round").alias("round"))


def multi_seed_findings(spark, folder):
    pages = _pages(spark, folder)
    apexes = _apex_seeds(pages).withColumn("seed_id", -F.col("seed_id") - 1)
    seeds = _host_seeds(pages).unionByName(apexes)
    found = discovery.findings(fixtures.pages_rich(pages), seeds)
    return found.groupBy("seed_id", "kind").agg(F.count(F.lit(1)).alias("findings"))


def render_candidates(spark, folder):
    pages = _pages(spark, folder)
    seeds = _host_seeds(pages)
    rows = fixtures.pages_meta(pages).withColumn("host", urls.url_host(F.col("url")))
    rows = rows.select("page_id", "url", "host", "status", "content_type", F.octet_length("html").alias("raw_length"))
    rows = scope.attach_seeds(rows, seeds).where(scope.in_scope(F.col("url")))
    return frontier.render_candidates(rows, seeds)


def blocked_resources(spark, folder):
    pages = _pages(spark, folder)
    kept = frontier.loadable_resources(fixtures.network_log(pages, _host_seeds(pages)))
    return kept.select("seed_id", "page_id", "resource_type", "request_url")


# Reports


def status_report(spark, folder):
    return reports.status_counts(fixtures.pages_meta(_pages(spark, folder)))


def broken_links(spark, folder):
    pages = _pages(spark, folder)
    return reports.dangling_links(extract.link_edges(fixtures.pages_rich(pages)), pages)


def js_inventory(spark, folder):
    found = _rich_findings(spark, folder, scans=("quoted", "tag")).where("kind = 'javascript'")
    return reports.assets_by_host(found)


def bundle_fingerprint(spark, folder):
    found = _rich_findings(spark, folder, scans=("quoted", "tag")).where("kind = 'javascript'")
    return reports.bundles(found).select("seed_id", "output")


def historical_endpoints(spark, folder):
    return reports.keyword_urls(archive_union(spark, folder))


def _admin_url():
    admin = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", r"(^https?://[^/]+)/", "$1/Admin/"))
    return F.coalesce(admin, "url")


def historical_endpoints_admin(spark, folder):
    """As historical_endpoints, over archives in which every fourth page lies under an administrative path."""
    pages = _pages(spark, folder)
    seeds = _apex_seeds(pages).withColumn("archive_domain", F.col("host"))
    old = pages.withColumn("url", _admin_url())
    found = ingest.archive_union(
        seeds, ingest.snapshot_urls(fixtures.archive_cdx(old)), ingest.index_urls(fixtures.archive_lines(old)), ingest.report_urls(fixtures.archive_report(old))
    )
    return reports.keyword_urls(found)


def admin_forms(spark, folder):
    pages = _pages(spark, folder)
    rich = fixtures.pages_rich(pages).withColumn("url", _admin_url())
    found = discovery.findings(rich, _host_seeds(pages), scans=("tag",))
    found = found.where(F.col("kind").isin("form", "upload-form"))
    return reports.keyword_urls(found, "output", reports.ADMIN_WORD).select("seed_id", "kind", "output")


def subdomain_enum(spark, folder):
    found = _rich_apex(spark, folder, "host").withColumn("domain", urls.url_host(F.col("input")))
    return reports.subdomains_by_apex(found)


def findings_summary(spark, folder):
    return reports.kind_summary(_rich_findings(spark, folder))


def findings_summary_whole(spark, folder):
    """Counts of every kind, from all producers."""
    return reports.kind_summary(_whole_findings(spark, folder))


# Streams: run to the end of the stored input, then read back what was written.


def stream_findings(spark, folder):
    seeds = _host_seeds(_pages(spark, folder))
    out = streams.run_discovery(spark, f"{folder}/pages.parquet", seeds, fixtures.pages_rich)
    return out.select("seed_id", "kind", "page_id", "output").distinct()


def stream_dedup(spark, folder):
    seeds = _host_seeds(_pages(spark, folder))
    out = streams.run_dedup(spark, f"{folder}/pages.parquet", seeds, fixtures.pages_rich)
    return out.select("seed_id", "set_name", "key")


def stream_sink(spark, folder):
    seeds = _host_seeds(_pages(spark, folder))
    out = streams.run_host_sink(spark, f"{folder}/pages.parquet", seeds, fixtures.pages_rich)
    return out.groupBy("host_key").agg(F.count(F.lit(1)).alias("lines"))


def stream_frontier(spark, folder):
    pages = _pages(spark, folder)
    out = streams.run_frontier(
        spark, f"{folder}/pages.parquet", _host_seeds(pages), _visited(pages), fixtures.pages_rich
    )
    return out.select("seed_id", "url")


NAMES = """
load_targets normalize_targets scan_pages wayback_urls commoncrawl_urls latest_index report_urls paged_urls
robots_urls sitemap_urls sitemap_index_urls wellknown_candidates archive_union archive_host_match network_urls
findings_json findings_text findings_quiet findings_by_host raw_bodies
scope_filter scope_rules include_filter include_anywhere exclude_filter static_asset_filter kind_filter length_filter body_cap
error_status_filter asset_status_filter content_type_gate noise_filter absolute_links asset_inventory
redirect_scope in_scope_pages in_scope_responses
href_links script_assets form_pages upload_form_pages quoted_links asset_quoted_links asset_quoted_links_whole asset_feed
unminified_variants subdomains s3_buckets url_findings link_edges
seen_dedup exact_unique kind_precedence canonical_dedup
new_frontier registrable_domain pages_by_seed frontier_fetch
all_findings all_findings_whole
crawl_frontier crawl_unlimited crawl_depths crawl_depths_unlimited crawl_seeded multi_seed_findings render_candidates blocked_resources
broken_links status_report js_inventory bundle_fingerprint historical_endpoints historical_endpoints_admin admin_forms subdomain_enum
findings_summary findings_summary_whole
stream_findings stream_dedup stream_sink stream_frontier
""".split()

QUERIES = {name: globals()[name] for name in NAMES}
