"""Summaries over findings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..schema import KINDS
from .joins import lookup_join

# What the keyword reports look for.
ENDPOINT_WORDS = "(?i)api|v1|v2|admin"
ADMIN_WORD = "(?i)admin"
BUNDLE = r"\.(min\.js|bundle\.js)"


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


def dangling_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Link targets on a stored host that no stored page has, with the pages linking there.

    Links are counted per target before the join.
    """
    known = urls.with_canonical(pages.select("url"), "url").where("canonical is not null")
    targets = edges.where("dst is not null").groupBy("dst").agg(F.count(F.lit(1)).alias("links"))
    targets = targets.withColumn("host", urls.url_host(F.col("dst")))
    hosts = known.select(urls.url_host(F.col("canonical")).alias("host")).distinct()
    missing = targets.join(known.select(F.col("canonical").alias("dst")).distinct(), "dst", "left_anti")
    return lookup_join(missing, hosts, "host", "left_semi").select("host", "dst", "links")


def assets_by_host(assets: DataFrame) -> DataFrame:
    host = urls.url_host(F.col("output"))
    return assets.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("scripts"))


def bundles(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("output").rlike(BUNDLE))


def keyword_urls(rows: DataFrame, url: str = "url", words: str = ENDPOINT_WORDS) -> DataFrame:
    return rows.where(F.col(url).rlike(words))


def subdomains_by_apex(found: DataFrame) -> DataFrame:
    """Distinct subdomains per apex; ``found`` carries ``domain`` and ``output``."""
    return found.select("domain", "output").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("subdomains"))


def kind_summary(found: DataFrame) -> DataFrame:
    """Findings per seed, one column per kind."""
    counts = found.groupBy("seed_id").pivot("kind", KINDS).agg(F.count(F.lit(1)))
    return counts.select(
        "seed_id", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k.replace("-", "_")) for k in KINDS]
    )
