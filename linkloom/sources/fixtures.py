"""Inputs derived from the ``pages`` table where a landed table is not at hand.

Every row comes from a page, so the derived tables grow with it. Groups are cut
by page id into pieces of fixed size; nothing collects a whole host.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..operators.dedup import first_seen
from ..operators.frontier import distinct_pages
from ..operators.joins import lookup_join

PIECE = 100  # pages per robots file, sitemap or archive payload
LISTING = 20  # URLs per listing page
RUN = 100_000  # page ids per run when pages are chained

# Public-suffix rules for the hosts in the test data and the documented examples.
SUFFIX_RULES = ["com", "net", "org", "ua", "com.ua", "*.ck", "!www.ck"]


def suffix_rules(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in SUFFIX_RULES])).alias("rule"))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))


def host_targets(pages: DataFrame) -> DataFrame:
    """One raw target per host: the URL of its first page."""
    named = with_host(pages.select("page_id", "url"))
    first = first_seen(named, ["host"], ["page_id"])
    return first.select(F.col("page_id").alias("seed_id"), F.col("url").alias("raw"))


def mixed_targets(pages: DataFrame) -> DataFrame:
    """Targets per host, padded: bare hosts where the first page id is even, URLs elsewhere."""
    named = with_host(pages.select("page_id", "url"))
    first = first_seen(named, ["host"], ["page_id"])
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "host", F.lit("\t"))).otherwise(F.col("url"))
    return first.select(F.col("page_id").alias("seed_id"), raw.alias("raw"))


def apex_targets(pages: DataFrame) -> DataFrame:
    """One bare target per two-label apex."""
    apex = F.substring_index("host", ".", -2)
    named = with_host(pages.select("page_id", "url")).withColumn("apex", apex)
    return named.groupBy("apex").agg(F.min("page_id").alias("seed_id")).select("seed_id", F.col("apex").alias("raw"))


def pages_meta(pages: DataFrame) -> DataFrame:
    digit = F.col("page_id") % 10
    status = F.when(digit == 0, 404).when(digit == 1, 403).when(digit == 2, 500).when(digit == 3, 429).otherwise(200)
    content = F.when(F.col("page_id") % 7 == 0, "").when(F.col("page_id") % 11 == 0, "application/json")
    return pages.withColumns({"status": status, "content_type": content.otherwise("text/html")})


def pages_rich(pages: DataFrame) -> DataFrame:
    """Pages with script, style, absolute link, forms, a bucket and a subdomain appended."""
    host, number = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.col("page_id")

    def text_of(n):
        return n.cast("string")

    extra = F.concat(
        F.lit("<script src=\"/js/"), text_of(number % 5), F.lit('.min.js"></script><link href="/s.css">'),
        F.lit('<a href="//cdn.'), host, F.lit('/p.html">p</a>'),
        F.when(number % 3 == 0, '<form action="/f">').otherwise(""),
        F.when(number % 6 == 0, "<input type='file'>").otherwise(""),
        F.lit('<i title="b'), text_of(number), F.lit('.s3.amazonaws.com"> api'), text_of(number % 4), F.lit("."), host,
        F.lit(" </i>"),
    )
    return pages.withColumn("html", F.concat("html", extra))


def script_bodies(pages: DataFrame) -> DataFrame:
    """Stored scripts: a page body per plain script name of its host."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    name = F.concat(origin, F.lit("/js/"), (F.col("page_id") % 5).cast("string"), F.lit(".js"))
    narrow = pages.select("page_id", name.alias("script"))
    chosen = narrow.groupBy("script").agg(F.min("page_id").alias("page_id"))
    return lookup_join(pages, chosen, "page_id").select("page_id", F.col("script").alias("url"), "html")


def page_scripts(pages: DataFrame) -> DataFrame:
    """Stored scripts: the body of every page as a script of its own."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    name = F.concat(origin, F.lit("/js/"), F.col("page_id").cast("string"), F.lit(".js"))
    return pages.select("page_id", name.alias("url"), "html")


def pages_own_script(pages: DataFrame) -> DataFrame:
    """Pages that link the minified name of their script in :func:`page_scripts`."""
    link = F.concat(F.lit('<script src="/js/'), F.col("page_id").cast("string"), F.lit('.min.js"></script>'))
    return pages.withColumn("html", F.concat("html", link))


def chain(pages: DataFrame) -> DataFrame:
    """First page per canonical URL with ``next_url``, the following page of its host.

    The next page is looked for inside runs of page ids, then from the end of one
    run to the start of the next, so no task sorts a whole host.
    """
    first = distinct_pages(pages).withColumn("host", F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    first = first.withColumn("run", F.floor(F.col("page_id") / RUN))
    inside = Window.partitionBy("host", "run").orderBy("page_id")
    linked = first.withColumn("next_url", F.lead("url").over(inside))
    heads = first_seen(first.select("host", "run", "page_id", "url"), ["host", "run"], ["page_id"])
    across = Window.partitionBy("host").orderBy("run")
    heads = heads.select("host", "run", F.lead("url").over(across).alias("run_url"))
    joined = linked.join(heads, ["host", "run"])
    return joined.select("page_id", "canonical", F.coalesce("next_url", "run_url").alias("next_url"))


def pages_chain(pages: DataFrame, quoted: bool = False) -> DataFrame:
    """Pages linked into one chain per host, by a tag link without or with quotes."""
    mark = '"' if quoted else ""
    link = F.concat(F.lit(f"<a href={mark}"), F.col("next_url"), F.lit(f"{mark}>next</a>"))
    joined = pages.join(chain(pages), "page_id")
    return joined.select("page_id", "url", F.concat("html", F.coalesce(link, F.lit(""))).alias("html"))


def chain_graph(pages: DataFrame) -> DataFrame:
    """The links :func:`pages_chain` adds, as graph rows, without moving any body."""
    links = chain(pages).where("next_url is not null").withColumnRenamed("canonical", "src")
    links = urls.with_canonical(links, "next_url", "dst")
    return links.select(
        "src", "dst", F.lit("href").alias("kind"), F.lit(1).alias("phase"), "page_id", F.lit(1 << 20).alias("ord")
    )


def robots(pages: DataFrame) -> DataFrame:
    """robots files: one rule per page path, every third one an allowance."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    rule = F.when(F.col("page_id") % 3 == 0, "Allow: ").otherwise("Disallow: ")
    return _pieces(pages, F.concat(rule, path), PIECE, lambda lines: F.array_join(lines, "\n"), "body")


def _pieces(pages: DataFrame, value, size: int, pack, name: str) -> DataFrame:
    """Pack one value per page into a text per host and run of ``size`` page ids."""
    rows = with_host(pages.select("page_id", "url")).select(
        "host", F.floor(F.col("page_id") / size).alias("part"), F.struct("page_id", value.alias("v")).alias("r")
    )
    packed = rows.groupBy("host", "part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return packed.select("host", "part", pack(F.col("rs.v")).alias(name))


def _escaped(url):
    return F.replace(url, F.lit("&"), F.lit("&amp;"))


def sitemaps(pages: DataFrame) -> DataFrame:
    """Sitemap files of each host, and index files that list them."""
    loc = F.concat(F.lit("<url><loc> "), _escaped(F.col("url")), F.lit(" </loc></url>"))
    sets = _pieces(pages, loc, PIECE, lambda v: F.array_join(v, ""), "items")
    part = F.col("part").cast("string")
    name = F.concat(F.lit("https://"), "host", F.lit("/sitemap-"), part, F.lit(".xml"))
    head = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    files = sets.select("host", "part", name.alias("url"), F.concat(F.lit(head), "items", F.lit("</urlset>")).alias("xml"))
    entries = files.select(
        "host",
        F.floor(F.col("part") / PIECE).alias("part"),
        F.struct("part", F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")).alias("v")).alias("r"),
    )
    packed = entries.groupBy("host", "part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    index_name = F.concat(F.lit("https://"), "host", F.lit("/sitemap_index-"), F.col("part").cast("string"), F.lit(".xml"))
    index_xml = F.concat(F.lit("<sitemapindex>"), F.array_join("rs.v", ""), F.lit("</sitemapindex>"))
    return files.unionByName(packed.select("host", "part", index_name.alias("url"), index_xml.alias("xml")))


def _apex(pages: DataFrame) -> DataFrame:
    named = with_host(pages.select("page_id", "url"))
    return named.withColumn("domain", F.substring_index("host", ".", -2))


def archive_cdx(pages: DataFrame) -> DataFrame:
    """Array-of-arrays listings per apex, with a header row and short rows."""
    rows = _apex(pages).select(
        "domain",
        F.floor(F.col("page_id") / PIECE).alias("part"),
        F.struct("page_id", F.array((F.col("page_id") + 20200000000000).cast("string"), "url").alias("v")).alias("r"),
    )
    packed = rows.groupBy("domain", "part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    header = F.array(F.array(F.lit("timestamp"), F.lit("original")))
    short = F.array(F.array(F.lit("short")))
    return packed.select("domain", F.to_json(F.concat(header, F.col("rs.v"), short)).alias("payload"))


def archive_lines(pages: DataFrame) -> DataFrame:
    """JSON lines per page; every thirteenth page adds nothing but a broken line."""
    line = F.to_json(F.struct("url", (F.col("page_id") + 20200000000000).cast("string").alias("timestamp")))
    broken = F.when(F.col("page_id") % 13 == 0, '{"url": "http://broken').otherwise(line)
    return _apex(pages).select("domain", broken.alias("line"))


def archive_report(pages: DataFrame) -> DataFrame:
    rows = _apex(pages).select(
        "domain",
        F.floor(F.col("page_id") / PIECE).alias("part"),
        F.struct("page_id", F.struct("url").alias("v")).alias("r"),
    )
    packed = rows.groupBy("domain", "part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    good = F.to_json(F.struct(F.col("rs.v").alias("detected_urls")))
    return packed.select("domain", F.when(F.col("part") % 5 == 4, "not json").otherwise(good).alias("payload"))


def archive_paged(pages: DataFrame) -> DataFrame:
    """Listings of twenty page ids per page; the last page of an apex has no successor."""
    rows = _apex(pages).select(
        "domain",
        F.floor(F.col("page_id") / LISTING).cast("int").alias("page"),
        F.struct("page_id", F.struct("url").alias("v")).alias("r"),
    )
    packed = rows.groupBy("domain", "page").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    last = packed.groupBy("domain").agg(F.max("page").alias("last"))
    joined = lookup_join(packed, last, "domain")
    payload = F.to_json(F.struct((F.col("page") < F.col("last")).alias("has_next"), F.col("rs.v").alias("url_list")))
    return joined.select("domain", "page", payload.alias("payload"))


def index_lists(pages: DataFrame) -> DataFrame:
    """An index list per page, newest first; every ninth is empty."""
    number = F.col("page_id")

    def entry(step):
        name = F.concat(F.lit("CC-"), (number + 2 - step).cast("string"))
        return F.struct(name.alias("id"), name.alias("name"), F.lit("x").alias("cdx-api"))

    entries = F.to_json(F.array(entry(0), entry(1)))
    return pages.select(number.alias("list_id"), F.when(number % 9 == 0, "[]").otherwise(entries).alias("payload"))


# Resource types dealt out by page id.
_RESOURCES = ["XHR", "Fetch", "Image", "Stylesheet", "Font", "Script"]


def network_log(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Requests per page: its own URL, and every fourth page one off its host."""
    kind = F.element_at(F.array(*[F.lit(r) for r in _RESOURCES]), (F.col("page_id") % 6 + 1).cast("int"))
    request = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("https://cdn."), "host", F.lit("/x"))).otherwise(F.col("url"))
    rows = with_host(pages.select("page_id", "url"))
    named = with_host(seeds.select("seed_id", "url")).select("seed_id", "host")
    rows = lookup_join(rows, named, "host")
    return rows.select("seed_id", "page_id", F.col("url").alias("page_url"), kind.alias("resource_type"), request.alias("request_url"))


def redirects(pages: DataFrame) -> DataFrame:
    """A redirect per page, to the page three ids on, on its own host's name or elsewhere."""
    rows = with_host(pages.select("page_id", "url"))
    target = rows.select((F.col("page_id") - 3).alias("page_id"), F.col("url").alias("next_url"))
    joined = rows.join(target, "page_id", "left")
    sub = F.concat(F.lit("https://m."), "host", F.lit("/"))
    hop = F.when(F.col("page_id") % 4 == 0, sub).when(F.col("page_id") % 4 == 1, F.col("url")).otherwise(F.col("next_url"))
    return joined.select("page_id", F.col("host").alias("base_host"), hop.alias("target_url")).where("target_url is not null")
