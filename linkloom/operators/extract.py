"""From pages to link rows: one pass over each body, then columns on narrow rows.

``scan`` reads a body once and leaves one row per token; the body itself never
enters a shuffle. ``resolve`` turns tokens into URLs and ``classify`` names what
each row is.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, patterns, text, urls
from .joins import spread

SCANS = ("response", "host", "bucket", "quoted", "tag")
TEXT_PHASE, TAG_PHASE = 0, 1
MAX_WORDS_BYTES = 1 << 20  # larger bodies are scanned whole for hosts and buckets, as their words would fill a task's memory
_TOKENS = "array<struct<scan:string,ord:int,token:string>>"


def responses(pages: DataFrame, max_scan: int | None = None) -> DataFrame:
    """Add what the gates need: host, decoded body, byte length, content flags.

    ``status`` and ``content_type`` default to a successful HTML response. Errors
    report their raw length. With ``max_scan``, so do bodies over that many bytes,
    which are then not decoded.
    """
    df = pages
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit(200))
    if "content_type" not in df.columns:
        df = df.withColumn("content_type", F.lit("text/html"))
    raw = F.octet_length("html")
    body = text.decoded(F.col("html"))
    df = df.withColumn("decoded", body if max_scan is None else F.when(raw <= max_scan, body))
    return df.withColumns(
        {
            "host": urls.url_host(F.col("url")),
            "length": F.coalesce(F.when(is_success(F.col("status")), F.octet_length("decoded")), raw).cast("int"),
        }
    )


def is_success(status: Column) -> Column:
    """Responses that reach the extraction callbacks; the rest are errors."""
    return status < 203


def reported_error(status: Column) -> Column:
    """Error responses that are still reported."""
    return (status >= 100) & (status < 500) & ~status.isin(404, 429)


def scanned_asset(status: Column) -> Column:
    """Script responses that are scanned."""
    return (status >= 100) & ~status.isin(404, 429)


def may_hold_links(content_type: Column) -> Column:
    """Content types whose text is scanned for quoted links."""
    kind = F.lower(content_type)
    return F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml")) | (kind == "")


def _tokens(scan: str, values: Column, gate: Column | None = None) -> Column:
    rows = F.transform(values, lambda v, i: F.struct(F.lit(scan).alias("scan"), i.alias("ord"), v.alias("token")))
    if gate is not None:
        rows = F.when(gate, rows)
    return F.coalesce(rows.cast(_TOKENS), F.array().cast(_TOKENS))


def scan(
    pages: DataFrame,
    scans: tuple[str, ...] = SCANS,
    text_gate: Column | None = None,
    scripts: bool = False,
    rewrite_over: int | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per token found by the chosen scans, with ``scan``, ``ord`` and ``token``.

    ``pages`` comes from :func:`responses`, with any further columns to carry
    along. ``text_gate`` switches the text scans of a row off. With ``scripts`` the bodies are
    script files: no content-type gate and no tags. Bodies over ``rewrite_over`` bytes are broken
    after punctuation before the link scan; by default none is. ``attach`` is applied to the pages between scan and
    tokens, when bodies are gone and each page is one row.
    """
    success = is_success(F.col("status"))
    if scripts:
        success = success & scanned_asset(F.col("status"))
    gate = F.col("decoded").isNotNull() & success
    if text_gate is not None:
        gate = gate & text_gate
    body = F.col("decoded")
    df = pages.withColumn("base", urls.split_url(F.col("url")))
    arrays = []
    if "response" in scans:
        shown = success if scripts else success | reported_error(F.col("status"))
        arrays.append(_tokens("response", F.array(F.lit("")), shown))
    dotted = F.col("_dotted")
    if "host" in scans or "bucket" in scans:
        df = df.withColumn("_dotted", F.when(F.octet_length(body) <= MAX_WORDS_BYTES, text.dotted_words(body)).otherwise(body))
    if "host" in scans:
        runs = F.regexp_extract_all(dotted, F.lit(patterns.HOST_RUN), F.lit(0))
        arrays.append(_tokens("host", F.array_distinct(runs), gate))
    if "bucket" in scans:
        named = gate & (F.contains(dotted, F.lit("s3")) | F.contains(dotted, F.lit("S3")))
        found = F.array_distinct(F.regexp_extract_all(dotted, F.lit(patterns.BUCKET), F.lit(0)))
        arrays.append(_tokens("bucket", found, named))
    if "quoted" in scans:
        df = df.withColumn("_source", body if rewrite_over is None else text.split_long_body(body, rewrite_over)).withColumn("_source", text.decoded(F.col("_source")))
        found = F.regexp_extract_all(F.col("_source"), F.lit(patterns.QUOTED_LINK), F.lit(1))
        lines = F.array_distinct(F.filter(F.transform(found, text.one_line), lambda t: t != ""))
        arrays.append(_tokens("quoted", lines, gate if scripts else gate & may_hold_links(F.col("content_type"))))
    if "tag" in scans and not scripts:
        is_html = success & F.contains(F.lower("content_type"), F.lit("html"))
        df = df.withColumn("_tags", F.when(is_html, html.start_tags(F.col("html"))))
        based = F.filter("_tags", lambda t: t.rlike("(?i)^<base") & html.has_attribute(t, "href"))
        df = df.withColumn("_base_tag", F.try_element_at(based, F.lit(1)))
        df = df.withColumn("_base_ref", html.browser_reference(html.attribute(F.col("_base_tag"), "href")))
        arrays.append(_tokens("tag", F.col("_tags")))
    df = df.withColumn("_found", F.concat(*arrays))
    dropped = ["html", "decoded", "content_type", "_dotted", "_source", "_tags", "_base_tag"]
    df = urls.pinned(df.drop(*dropped), "_found", *([] if "_base_ref" not in df.columns else ["_base_ref"]))
    if "_base_ref" in df.columns:
        df = urls.with_resolved(df, "base", "_base_ref", "_doc")
        df = df.withColumn("tag_base", F.coalesce(urls.split_url(F.col("_doc")), F.col("base")))
        df = df.drop("_base_ref", "_doc", "_doc_canon", "_doc_path", "_doc_absolute")
    if attach is not None:
        df = attach(df)
    kept = [c for c in df.columns if c != "_found"]
    return df.select(*kept, F.inline_outer("_found")).where("scan is not null")


def resolve(tokens: DataFrame) -> DataFrame:
    """Resolve quoted tokens and tag attributes against their page.

    Adds ``element``, ``has_link`` (the tag carries its link attribute) and the
    ``resolved`` columns. A tag link that is only a
    fragment, or that cannot be parsed, stands for the seed and stays NULL.
    """
    is_tag, is_quoted = F.col("scan") == "tag", F.col("scan") == "quoted"
    token, element = F.col("token"), F.col("element")
    df = tokens.withColumn("element", F.when(is_tag, html.tag_name(token)))
    has_href = element.isin("a", "link") & html.has_attribute(token, "href")
    has_src = (element == "script") & html.has_attribute(token, "src")
    written = F.when(has_href, html.attribute_text(token, "href")).when(has_src, html.attribute_text(token, "src"))
    df = df.withColumn("_written", written).withColumn("_value", html.attribute_value(F.col("_written")))
    reference = F.when(is_quoted, token).when(~F.col("_value").startswith("#"), html.browser_reference(F.col("_value")))
    df = df.withColumn("_ref", reference)
    if "tag_base" in df.columns:
        df = df.withColumn("base", F.when(is_tag, F.col("tag_base")).otherwise(F.col("base"))).drop("tag_base")
    has_scheme = F.col("_ref").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]")
    df = urls.with_resolved(df, "base", "_ref", keep_dots=is_quoted & has_scheme)
    return df.withColumn("has_link", F.col("_value").isNotNull()).drop("base", "_written", "_value", "_ref")


def classify(rows: DataFrame, scripts: bool = False) -> DataFrame:
    """Name each resolved row and drop what is nothing.

    Adds ``kind``, ``type``, ``source``, ``link``, ``canon``, ``set_name`` and
    ``phase``. Uses ``seed_url`` and ``seed_canon`` where the rows have them, for
    tag links that stand for the seed.
    """
    seeded = "seed_url" in rows.columns
    seed_url = F.col("seed_url") if seeded else F.lit(None).cast("string")
    seed_canon = F.col("seed_canon") if seeded else F.lit(None).cast("string")
    scan_, token, element = F.col("scan"), F.col("token"), F.col("element")
    to_seed = (scan_ == "tag") & element.isin("a", "link", "script")
    df = rows.withColumns(
        {
            "link": F.coalesce("resolved", F.when(to_seed, seed_url)),
            "canon": F.coalesce("resolved_canon", F.when(to_seed, seed_canon)),
        }
    )
    ending = urls.extension(F.regexp_extract("canon", r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1))
    df = df.withColumn("_ext", ending)
    scanned = F.col("_ext").isin(patterns.SCANNED_EXTENSIONS) & ~F.col("resolved_absolute")
    kind = (
        F.when(scan_ == "response", "url")
        .when(scan_ == "host", "subdomains")
        .when(scan_ == "bucket", "aws")
        .when((scan_ == "quoted") & (F.col("link").isNull() | text.is_noise(token)), None)
        .when(scan_ == "quoted", F.when(scanned, "javascript").otherwise("linkfinder"))
        .when(element.isin("a", "link"), F.when(F.col("has_link"), "href"))
        .when(element == "form", F.when(html.has_attribute(token, "action"), "form"))
        .when(element == "input", F.when(html.attribute(token, "type") == "file", "upload-form"))
        .when(
            element == "script",
            F.when(F.col("has_link") & F.col("_ext").isin(patterns.SCRIPT_TAG_EXTENSIONS), "javascript"),
        )
    )
    df = df.withColumn("kind", kind)
    static = (F.col("kind") == "href") & F.coalesce(F.col("link").rlike(patterns.STATIC_ASSET), F.lit(False))
    is_asset, quoted = F.col("kind") == "javascript", scan_ == "quoted"
    df = df.withColumns(
        {
            "kind": F.when(~static, F.col("kind")),
            "type": F.when(is_asset & quoted, "linkfinder")
            .when(F.col("kind") == "subdomains", "subdomain")
            .otherwise(F.col("kind")),
            "source": F.when(is_asset & quoted, "javascript" if scripts else "html")
            .when(quoted, F.col("url"))
            .otherwise("body"),
            "set_name": F.when(is_asset, "js")
            .when(F.col("kind").isin("href", "linkfinder"), "link")
            .otherwise(F.col("kind")),
            "phase": F.when(scan_ == "tag", TAG_PHASE).otherwise(TEXT_PHASE),
        }
    )
    named = ["kind", "type", "source", "set_name", "phase", "link", "canon"]
    df = urls.pinned(df.drop("_ext", "resolved", "resolved_canon", "resolved_path", "has_link"), *named)
    return df.where("kind is not null")


def link_edges(pages: DataFrame, scripts: bool = False) -> DataFrame:
    """The link graph before any de-duplication: every tag and quoted link of every page.

    ``dst`` is NULL for tag links that stand for the seed; no scope is applied. With ``scripts``
    the bodies are script files.
    """
    rows = classify(resolve(scan(responses(spread(pages, "page_id")), ("quoted", "tag"), scripts=scripts)), scripts)
    rows = rows.where(F.col("kind").isin("href", "linkfinder", "javascript"))
    rows = rows.where(F.col("canon").isNotNull() | (F.col("kind") == "href"))
    return rows.select(
        "page_id",
        F.col("url").alias("src"),
        F.col("canon").alias("dst"),
        F.col("link"),
        "kind",
        "type",
        "phase",
        "ord",
    )


def unminified(assets: DataFrame, url: str = "output") -> DataFrame:
    """Extra fetch targets: each minified script under its plain name."""
    return assets.where(F.contains(url, F.lit(".min.js"))).withColumn(
        url, F.replace(F.col(url), F.lit(".min.js"), F.lit(".js"))
    )
