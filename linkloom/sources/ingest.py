"""Readers that turn landed payloads into rows, with explicit schemas throughout."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import patterns, text, urls
from ..operators.dedup import first_seen
from ..operators.joins import lookup_join
from ..operators.scope import in_scope
from ..session import materialized


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schema.PAGES).parquet(f"{folder}/pages.parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a text file, one per line."""
    return load_targets(spark.read.text(path).withColumnRenamed("value", "raw"))


def load_targets(*sources: DataFrame) -> DataFrame:
    """Union of target lines: trimmed, blanks dropped, repeats kept."""
    lines = sources[0]
    for more in sources[1:]:
        lines = lines.unionByName(more, allowMissingColumns=True)
    return lines.withColumn("raw", text.trimmed(F.col("raw"))).where("raw <> ''")


def snapshot_urls(payloads: DataFrame) -> DataFrame:
    """URLs of array-of-arrays listings: header row skipped, short rows skipped."""
    rows = payloads.select("domain", F.posexplode(F.from_json("payload", schema.CDX_ARRAY)).alias("pos", "cols"))
    rows = rows.where((F.col("pos") > 0) & (F.size("cols") >= 2))
    return rows.select("domain", F.col("cols")[0].alias("ts"), F.col("cols")[1].alias("url")).where("url <> ''")


def index_urls(lines: DataFrame) -> DataFrame:
    """URLs of JSON-lines listings: malformed lines and empty URLs skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("domain", F.from_json("line", schema.CDX_LINE, options).alias("j"))
    parsed = parsed.where("j._bad is null and j.url <> ''")
    return parsed.select("domain", F.col("j.timestamp").alias("ts"), F.col("j.url").alias("url"))


def latest_index(lists: DataFrame) -> DataFrame:
    """First entry of each index list; a list that is empty yields nothing."""
    entries = lists.select("list_id", F.posexplode(F.from_json("payload", schema.INDEX_LIST)).alias("pos", "entry"))
    return entries.where("pos = 0").select("list_id", F.col("entry.id").alias("index_id"))


def report_urls(payloads: DataFrame) -> DataFrame:
    """Non-empty URLs of reports; a report that cannot be read holds none."""
    entries = payloads.select("domain", F.explode(F.from_json("payload", schema.REPORT)["detected_urls"]).alias("e"))
    return entries.select("domain", F.col("e.url").alias("url")).where("url <> ''")


def paged_urls(payloads: DataFrame, max_pages: int | None = None) -> DataFrame:
    """URLs of listings read page by page.

    A domain's pages count up to the first without ``has_next``; one unreadable page
    among them voids the domain. Where each listing ends is a minimum per domain, so
    a domain with very many pages sends one row per task. ``max_pages`` stops earlier.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    pages = payloads if max_pages is None else payloads.where(F.col("page") < max_pages)
    pages = pages.select("domain", "page", F.from_json("payload", schema.PAGED, options).alias("j"))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    more = F.coalesce(F.col("j.has_next"), F.lit(False)) & ~bad
    ends = pages.groupBy("domain").agg(F.min(F.when(~more, F.col("page"))).alias("last"), F.min(F.when(bad, F.col("page"))).alias("broken"))
    ends = materialized(ends.where("broken is null or broken > last").select("domain", "last"))
    read = lookup_join(pages, ends, "domain").where("last is null or page <= last")
    entries = read.select("domain", "page", F.explode("j.url_list").alias("e"))
    return entries.select("domain", "page", F.col("e.url").alias("url")).where("url <> ''")


def archive_union(seeds: DataFrame, *sources: DataFrame) -> DataFrame:
    """All archive URLs of each seed: exact distinct first, then trimmed, blanks dropped."""
    rows = sources[0].select("domain", "url")
    for more in sources[1:]:
        rows = rows.unionByName(more.select("domain", "url"))
    rows = rows.where("url <> ''").distinct()
    wanted = seeds.select("seed_id", F.col("archive_domain").alias("domain"))
    rows = lookup_join(rows, wanted, "domain").select("seed_id", "url")
    return rows.withColumn("url", text.trimmed(F.col("url"))).where("url <> ''")


def archive_host_match(rows: DataFrame, include_subs: bool) -> DataFrame:
    """Archive rows whose URL lies on the queried domain, or under it when asked for."""
    host, domain = urls.url_host(F.col("url")), F.col("domain")
    match = host == domain
    if include_subs:
        match = match | host.endswith(F.concat(F.lit("."), domain))
    return rows.where(match)


def robots_urls(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Allowed and disallowed paths of robots files, resolved against the seed.

    Every line counts, comments included; an empty rule is the seed itself.
    Repeats are kept.
    """
    lines = files.select("seed_id", "part", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    lines = lines.where(F.contains(F.lower("line"), F.lit("llow:")))
    rule = text.trimmed(F.regexp_replace("line", patterns.ROBOTS_PREFIX, ""))
    lines = lookup_join(lines.withColumn("rule", rule), seeds.select("seed_id", F.col("url").alias("seed_url")), "seed_id")
    lines = lines.withColumn("base", urls.split_url(F.col("seed_url")))
    found = urls.with_resolved(lines, "base", "rule").where("resolved is not null")
    return found.select("seed_id", "part", F.col("line_no").cast("int"), F.col("resolved").alias("url"))


def _sitemap(files: DataFrame) -> DataFrame:
    return files.withColumn("doc", F.from_xml("xml", F.lit(schema.SITEMAP)))


def _locations(df: DataFrame, field: str) -> DataFrame:
    kept = [c for c in df.columns if c not in ("doc", "xml", "url")]
    rows = df.select(*kept, F.explode(f"doc.{field}").alias("e"))
    return rows.select(*kept, text.trimmed(F.col("e.loc")).alias("url")).where("url <> ''")


def sitemap_urls(files: DataFrame) -> DataFrame:
    """Locations of sitemap files; files that are not XML hold none. Repeats are kept."""
    return _locations(_sitemap(files), "url")


def sitemap_index_urls(files: DataFrame) -> DataFrame:
    """Locations behind sitemap indexes, one level deep.

    A file with locations of its own is not an index. Each index entry is looked up among the
    stored files by URL; a file stored more than once is read once. Files are parsed where they
    are read, so only narrow rows are joined.
    """
    parsed = _sitemap(files)
    indexes = parsed.where("size(doc.url) <= 0 or doc.url is null")
    wanted = materialized(_locations(indexes.select("seed_id", "doc"), "sitemap").select("seed_id", F.col("url").alias("file_url")))
    held = parsed.select(F.col("url").alias("file_url"), F.xxhash64("xml").alias("copy"), F.col("doc.url.loc").alias("locs"))
    first = first_seen(held, ["file_url"], ["copy"]).select("file_url", F.explode("locs").alias("loc"))
    found = lookup_join(first, wanted, "file_url").select("seed_id", text.trimmed(F.col("loc")).alias("url"))
    return found.where("url <> ''")


def wellknown_candidates(seeds: DataFrame) -> DataFrame:
    """Where robots and sitemap files would be: the seed URL with each path appended."""
    paths = F.array(*[F.lit(p) for p in [patterns.ROBOTS_PATH, *patterns.SITEMAP_PATHS]])
    rows = seeds.select("seed_id", "url", F.explode(paths).alias("path"))
    return rows.select("seed_id", "path", F.concat("url", "path").alias("candidate"))


def network_requests(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """In-scope requests of rendered pages: ``seed_id, key, page_id, page_url, request_url``, repeats kept."""
    wanted = log.where(F.col("resource_type").isin(patterns.REQUEST_RESOURCES))
    wanted = wanted.withColumn("_parts", urls.split_url(F.col("request_url"))).where("_parts is not null")
    scoped = lookup_join(wanted, seeds.select("seed_id", "scope_host", "scope_subs", "scope_re"), "seed_id")
    scoped = scoped.where(in_scope(F.col("request_url"))).withColumn("key", F.lower("request_url"))
    return scoped.select("seed_id", "key", "page_id", "page_url", "request_url")


def network_urls(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """In-scope requests of rendered pages, once per seed and URL ignoring case.

    The first one in log order is kept, as it was written. What pages link to as well is not looked at here, see
    ``discovery.whole_findings``.
    """
    requests = network_requests(log, seeds).select("seed_id", "key", "page_id", "request_url")
    first = first_seen(requests, ["seed_id", "key"], ["page_id"])
    return first.select("seed_id", F.col("request_url").alias("url"))
