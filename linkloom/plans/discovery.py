"""Pages and seeds in, typed findings out."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, text, urls
from ..operators.dedup import first_seen
from ..operators.extract import SCANS, classify, is_success, resolve, responses, scan
from ..operators.joins import BROADCAST_BYTES, is_small, lookup_join, spread
from ..operators.scope import SCOPE_COLUMNS, attach_by_pattern, attach_seeds, host_map, in_scope, in_scope_by_host
from ..session import materialized
from ..schema import FINDING_COLUMNS
from ..sources.ingest import network_requests

SEED_COLUMNS = ["seed_id", "input", "seed_url", "seed_canon", "domain", *SCOPE_COLUMNS]
FINDING_KEYS = ["seed_id", "set_name", "key"]
NETWORK_PHASE = 2  # after the text and tag scans of a page
TEXT_SCANS = ["response", "host", "bucket", "quoted"]


def seed_columns(seeds: DataFrame) -> DataFrame:
    """Narrow scoped seeds to what the jobs carry: identity, printed URL, scope."""
    df = seeds.select("seed_id", "url", "domain", *SCOPE_COLUMNS, "attach_key")
    df = df.withColumns({"_base": urls.split_url(F.col("url")), "_same": F.lit("")})
    df = urls.with_resolved(df, "_base", "_same", "seed_url").withColumn("seed_canon", F.col("seed_url_canon"))
    return df.withColumn("input", F.col("url")).select(*SEED_COLUMNS, "attach_key")


def raw_findings(
    pages: DataFrame,
    seeds: DataFrame,
    scans: tuple[str, ...] = SCANS,
    scripts: bool = False,
    skip_lengths: tuple[int, ...] = (),
    strict: bool = False,
    limit: int = BROADCAST_BYTES,
    anywhere: bool = False,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Findings before de-duplication.

    Every body is scanned once, whatever the number of seeds whose scope covers it. Which hosts are covered is
    worked out first, from the URLs alone; a map that measures small enough leaves the pages of all other hosts out before
    their bodies are read. Seeds are attached to pages, when their bodies are gone and their tokens are one array, never to
    tokens. ``strict`` compares hosts instead of running the
    scope pattern on whole URLs. ``skip_lengths`` leaves out successful responses of these lengths. With
    ``anywhere`` a seed whose scope is a pattern has the pages that match it on all hosts, and not only those of its own domain.
    ``wanted`` (``seed_id``, ``url``) leaves out all other pages of a seed, before their tokens become rows.
    """
    covers = in_scope_by_host if strict else in_scope
    seeds = seed_columns(seeds)
    counted = ~F.col("length").isin(*skip_lengths) | ~is_success(F.col("status")) if skip_lengths else F.lit(True)
    pages, attach = _matched(pages, seeds, limit) if anywhere else _covered(pages, seeds, limit)

    def attached(rows: DataFrame) -> DataFrame:
        rows = attach(rows).withColumn("page_in_scope", covers(F.col("url")))
        if wanted is None:
            return rows
        return rows.join(F.broadcast(wanted) if is_small(wanted, limit) else wanted, ["seed_id", "url"], "left_semi")

    df = responses(pages).withColumn("_counted", counted)
    tokens = scan(df, scans, F.col("_counted"), scripts, attach=attached)
    tokens = tokens.where(F.col("page_in_scope") | F.col("scan").isin("response", "tag"))
    tokens = tokens.where(F.col("_counted") | (F.col("scan") != "response"))
    kind, token = F.col("kind"), F.col("token")
    under = F.contains(F.lower(token), F.concat(F.lit("."), F.lower("domain")))
    if "host" in scans:
        tokens = tokens.where((F.col("scan") != "host") | under)
    rows = classify(resolve(tokens), scripts)
    gated = F.col("set_name").isin("link", "js") & (F.col("type") != "javascript")
    rows = rows.where(~gated | covers(F.col("link")))
    rows = rows.withColumn("in_scope", F.when(gated, True).otherwise(covers(F.col("link"))))  # the filter has looked already
    domain = F.concat(F.lit(patterns.DNS_LABELS), F.replace(F.col("domain"), F.lit("."), F.lit("[.]")))
    hits = F.when((kind == "subdomains") & under, F.array_distinct(F.regexp_extract_all(token, domain, F.lit(0))))
    if "host" in scans:
        rows = rows.withColumn("_hit", F.explode_outer(hits)).where((kind != "subdomains") | F.col("_hit").isNotNull())
    else:
        rows = rows.withColumn("_hit", F.lit(None).cast("string"))
    output = (
        F.when(kind.isin("url", "form", "upload-form"), F.col("url"))
        .when(kind == "subdomains", text.clean_host(F.col("_hit")))
        .when(kind == "aws", text.decoded(token))
        .otherwise(F.col("canon"))
    )
    # Pages and scripts are tables of their own, so their ids may be alike.
    response_key = F.concat(F.lit("script "), F.col("page_id").cast("string")) if scripts else F.col("page_id").cast("string")
    key = (
        F.when(kind == "url", response_key)
        .when(F.col("type") == "javascript", F.lower("link"))
        .otherwise(F.lower("output"))
    )
    is_response = kind == "url"
    return (
        rows.withColumn("output", output)
        .withColumns(
            {
                "key": key,
                "status": F.when(is_response, F.col("status")).otherwise(0).cast("int"),
                "length": F.when(is_response, F.col("length")).otherwise(0).cast("int"),
                "depth": F.lit(1),
            }
        )
        .select(
            *FINDING_KEYS, "kind", *FINDING_COLUMNS, "in_scope", "depth", "phase", "page_id", "ord", F.col("url").alias("page_url")
        )
    )


def in_scope_bodies(pages: DataFrame, seeds: DataFrame, skip_lengths: tuple[int, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Decoded bodies of successful responses whose own URL is in the scope of a seed, one row for each such seed.

    Hosts decide which pages are looked at, then scope, status and raw size, and only what is left is decoded. A body
    meets its seeds where it was read, by a broadcast map of hosts; only a map beyond ``limit`` moves bodies.
    """
    pages, attach = _covered(pages, seed_columns(seeds), limit)
    rows = pages.withColumn("host", urls.url_host(F.col("url")))
    if "status" in rows.columns:
        rows = rows.where(is_success(F.col("status")))
    rows = responses(attach(rows).where(in_scope(F.col("url"))))
    rows = urls.pinned(rows, "decoded").where("decoded is not null")
    return rows.where(~F.col("length").isin(*skip_lengths)) if skip_lengths else rows


def _covered(pages: DataFrame, seeds: DataFrame, limit: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The pages to scan, and what attaches their seeds to them afterwards."""
    if pages.isStreaming:
        return pages, lambda rows: attach_seeds(rows, seeds, limit)
    covered = materialized(host_map(pages.select(urls.url_host(F.col("url")).alias("host")), seeds))
    if not is_small(covered, limit):
        return spread(pages, "page_id"), lambda rows: lookup_join(rows, covered, "host", limit=limit)
    known = covered.select(F.col("host").alias("_host")).distinct()
    kept = spread(pages, "page_id").withColumn("_host", urls.url_host(F.col("url")))
    kept = kept.join(F.broadcast(known), "_host", "left_semi").drop("_host")
    return kept, lambda rows: rows.join(F.broadcast(covered), "host")


def _matched(pages: DataFrame, seeds: DataFrame, limit: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """As :func:`_covered`, where scopes that are patterns hold on every host."""
    narrow = pages.select("page_id", "url").withColumn("host", urls.url_host(F.col("url")))
    named, patterned = seeds.where("scope_host is not null"), seeds.where("scope_host is null")
    rows = attach_by_pattern(narrow, patterned.drop("attach_key"), limit=limit)
    met = materialized(rows.unionByName(attach_seeds(narrow, named, limit).select(*rows.columns)).drop("url", "host"))
    if not is_small(met, limit):
        return spread(pages, "page_id"), lambda found: lookup_join(found, met, "page_id", limit=limit)
    kept = spread(pages, "page_id").join(F.broadcast(met.select("page_id").distinct()), "page_id", "left_semi")
    return kept, lambda found: found.join(F.broadcast(met), "page_id")


def findings(pages: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """Every finding once per seed, first occurrence kept, link kinds sharing one memory."""
    return first_seen(raw_findings(pages, seeds, **options), FINDING_KEYS)


def whole_findings(
    pages: DataFrame,
    seeds: DataFrame,
    scripts: DataFrame | None = None,
    log: DataFrame | None = None,
    listed: dict[str, DataFrame] | None = None,
    rendered: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Findings of all producers as one table: ``seed_id, kind`` and the record's columns.

    Producers that share a memory are merged by arrival: links, script assets and quoted links of pages
    come first, then requests of rendered pages (``log``), then what stands in the bodies of fetched ``scripts``,
    and of the scripts that these name, until no new one is found. A key belongs to the first of them. ``listed`` holds
    URLs (``seed_id``, ``url``) by kind (robots, sitemap, other-sources) and ``rendered`` the rendered pages;
    they have no memory, so repeats stay. Pages are scanned once, and what they give is reduced to one row for each key before
    anything else meets it; a round of scripts is compared with the keys that are known, never scanned again.
    """
    first = first_seen(raw_findings(pages, seeds, **options), FINDING_KEYS)
    if log is not None:
        first = first_seen(first.unionByName(_requests(log, seeds).select(*first.columns)), FINDING_KEYS)
    known = fresh = materialized(first)
    while scripts is not None:
        found = asset_findings(fresh.where("kind = 'javascript'"), scripts, seeds, **options)
        fresh = materialized(found.join(known.select(*FINDING_KEYS), FINDING_KEYS, "left_anti").select(*known.columns))
        known = known.unionByName(fresh)
        if fresh.where("kind = 'javascript' and in_scope").isEmpty():
            break
    kept = ["seed_id", "kind", *FINDING_COLUMNS]
    whole = known.select(*kept)
    inputs = seeds.select("seed_id", F.col("url").alias("input"))
    for kind, rows in {**(listed or {}), **({} if rendered is None else {"render": rendered})}.items():
        rows = lookup_join(rows.select("seed_id", F.col("url").alias("output")), inputs, "seed_id")
        labels = {"kind": F.lit(kind), "source": F.lit(kind), "type": F.lit("render" if kind == "render" else "url")}
        whole = whole.unionByName(rows.withColumns({**labels, "status": F.lit(0), "length": F.lit(0)}).select(*kept))
    return whole


def _requests(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """Requests of rendered pages as findings that share the memory of links."""
    rows = lookup_join(network_requests(log, seeds), seeds.select("seed_id", F.col("url").alias("input")), "seed_id")
    fixed = {"set_name": "link", "kind": "network", "source": "network", "type": "network"}
    rows = rows.withColumns({name: F.lit(value) for name, value in fixed.items()} | {"in_scope": F.lit(True)})
    return rows.withColumns({"status": F.lit(0), "length": F.lit(0), "depth": F.lit(1), "phase": F.lit(NETWORK_PHASE), "ord": F.lit(0)}).withColumnRenamed("request_url", "output")


def asset_findings(assets: DataFrame, scripts: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """Findings inside the bodies of fetched script assets.

    ``assets`` are javascript findings. Those in scope, and their un-minified
    variants, are looked up among the stored script bodies. Few of them are
    broadcast to cut the bodies that are read; many are matched to the scripts when
    their bodies are gone, since bodies are never shuffled.
    """
    wanted = fetch_targets(assets).select("seed_id", F.col("output").alias("url")).distinct()
    wanted = materialized(wanted)
    names = wanted.select("url").distinct()
    if is_small(names):
        scripts = scripts.join(F.broadcast(names), "url", "left_semi")
    return first_seen(raw_findings(scripts, seeds, scripts=True, wanted=wanted, **options), FINDING_KEYS)


def fetch_targets(assets: DataFrame) -> DataFrame:
    """Script assets to fetch: in scope, plus the plain name of each minified one."""
    crawlable = assets.where("in_scope")
    plain = F.replace(F.col("output"), F.lit(".min.js"), F.lit(".js"))
    names = F.when(F.contains("output", F.lit(".min.js")), F.array("output", plain)).otherwise(F.array("output"))
    return crawlable.withColumn("output", F.explode(names))


def kind_filter(found: DataFrame, allow: str = "", deny: str = "") -> DataFrame:
    """Keep the allowed kinds and drop the denied ones; both are comma-separated.

    Runs after de-duplication: a kind that is filtered out has still claimed its key.
    """
    allowed = [k.strip().lower() for k in allow.split(",") if k.strip()]
    denied = [k.strip().lower() for k in deny.split(",") if k.strip()]
    kind = F.lower("kind")
    if allow.strip():
        found = found.where(kind.isin(allowed) if allowed else F.lit(False))
    if denied:
        found = found.where(~kind.isin(denied))
    return found
