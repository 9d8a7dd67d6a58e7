"""Seeds, registrable domains and the scope rules that tie URLs to seeds."""

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..session import materialized
from .joins import BROADCAST_BYTES, is_small, lookup_join

# The one function here that runs in Python workers travels by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCOPE_COLUMNS = ["scope_host", "scope_subs", "scope_re"]
MAX_LABELS = 127  # fixed value: most labels a DNS name can have


def with_registrable_domain(df: DataFrame, host: str, rules: DataFrame, out: str = "domain") -> DataFrame:
    """Add the registrable domain of ``host``; NULL where the host is itself a public suffix.

    ``rules`` holds one public-suffix rule per row, ``*.`` and ``!`` forms included.
    Each distinct host is expanded to the rules that could match it and meets the
    rule table in an equi-join; exceptions beat longer rules, longer beat shorter,
    and the last label stands in when no rule applies.
    """
    rules = rules.select("rule").distinct()
    longest, size = rules.agg(
        F.coalesce(F.max(F.size(F.split("rule", r"\."))), F.lit(1)), F.coalesce(F.sum(F.octet_length("rule") + 64), F.lit(0))
    ).first()
    hosts = df.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    labels = F.size(F.split("_host", r"\."))
    depth = F.explode(F.sequence(F.lit(1), F.least(labels, F.lit(longest + 1))))
    suffix = F.expr("substring_index(_host, '.', -_n)")
    shorter = F.expr("substring_index(_host, '.', 1 - _n)")
    keys = F.array(suffix, F.concat(F.lit("!"), suffix), F.when(F.col("_n") > 1, F.concat(F.lit("*."), shorter)))
    expanded = hosts.select("_host", depth.alias("_n")).select("_host", "_n", F.explode(keys).alias("rule"))
    hits = expanded.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "rule")
    exception = F.col("rule").startswith("!")
    # The score orders rules and holds the label count of the public suffix in its last three digits.
    score = F.when(exception, 1000 + F.col("_n") - 1).otherwise(F.col("_n"))
    best = hits.groupBy("_host").agg((F.max(score) % 1000).alias("_suffix"))
    joined = hosts.join(best, "_host", "left").withColumn("_suffix", F.coalesce("_suffix", F.lit(1)))
    well_formed = ~F.col("_host").rlike(r"^\.|\.\.|\.\z|^\z") & (labels > F.col("_suffix"))
    domains = joined.select(
        "_host", F.when(well_formed, F.expr("substring_index(_host, '.', -(_suffix + 1))")).alias(out)
    )
    return df.withColumn("_host", F.col(host)).join(domains, "_host", "left").drop("_host")


def normalize_targets(raw: DataFrame, rules: DataFrame, target: str = "raw") -> DataFrame:
    """Turn raw targets into seeds.

    A target with a scheme keeps its URL and gets no override. A bare name
    becomes ``https://name`` scoped to its registrable domain with subdomains, or
    to its own host where it has none.
    """
    df = raw.withColumn("_raw", text.trimmed(F.col(target)))
    bare = ~F.contains("_raw", F.lit("://"))
    df = df.withColumn("url", F.when(bare, F.concat(F.lit("https://"), F.col("_raw"))).otherwise(F.col("_raw")))
    df = df.withColumn("_parts", urls.split_url(F.col("url")))
    authority = F.col("_parts")[urls.AUTHORITY]
    df = df.withColumns({"bare": bare, "host": urls.hostname(authority), "_full": F.substring(authority, 3, 1 << 30)})
    df = urls.pinned(df, "url", "host", "bare", "_full").where("host is not null")
    df = with_registrable_domain(df, "host", rules)
    override = F.when(F.col("bare"), F.coalesce("domain", "_full"))
    return df.withColumns({"scope_domain": override, "allow_subs": F.col("bare")}).drop("_raw", "_parts", "_full", "bare")


def scope_rules(
    seeds: DataFrame, subs: bool = False, include: str | None = None, include_domain: str | None = None
) -> DataFrame:
    """Add the scope of each seed: a host with or without subdomains, or a pattern.

    An override scopes to its domain. Otherwise subdomains count when asked for
    or when the seed sits on its registrable domain. ``include`` replaces all of
    that, and ``include_domain`` replaces even ``include``.
    """
    override = F.col("scope_domain").isNotNull()
    wide = ~override & (F.lit(subs) | (F.lower("host") == F.lower("domain")))
    host = F.when(override, F.col("scope_domain")).when(wide, F.col("domain")).otherwise(F.col("host"))
    sub = F.when(override, F.col("allow_subs")).otherwise(wide)
    key_host, key_sub = host, sub
    pattern = None
    if include_domain is not None:
        host, sub = F.lit(include_domain), F.lit(False)
        key_host, key_sub = host, sub
    elif include is not None:
        host, sub, pattern = F.lit(None).cast("string"), F.lit(False), F.lit(include)
        key_host, key_sub = F.coalesce("domain", "host"), F.lit(True)
    labels = F.when(F.col("scope_subs"), rf"(?:[^.]+\.){{0,{MAX_LABELS}}}").otherwise("")
    built = F.concat(
        F.lit("^https?://"), labels, text.quote_pattern(F.col("scope_host")), F.lit(r"(?::\d+)?(?:/|\z)")
    )
    seeds = seeds.withColumns({"scope_host": host, "scope_subs": sub, "_key_host": key_host, "_key_sub": key_sub})
    seeds = seeds.withColumn("scope_re", built if pattern is None else pattern)
    key = F.concat(F.when(F.col("_key_sub"), "d:").otherwise("h:"), F.col("_key_host"))
    return seeds.withColumn("attach_key", key).drop("_key_host", "_key_sub")


def in_scope(url: Column) -> Column:
    """Whether a URL is in the scope held by the row's scope columns.

    The plain host cases are decided by comparing hosts. The pattern itself is
    only run for custom scopes and for URLs that carry the scope host elsewhere,
    which the pattern lets in when a path segment ends with it.
    """
    known, subs = F.col("scope_host"), F.col("scope_subs")
    host = F.regexp_extract(url, r"^https?://([^/?#@:]*)(?::\d+)?(?:/|\z)", 1)
    under = subs & host.endswith(F.concat(F.lit("."), known)) & ~host.rlike(r"^\.|\.\.")
    decided = (
        F.when(known.isNull(), F.rlike(url, F.col("scope_re")))
        .when((host == known) | under, True)
        .when(~subs | ~F.contains(url, known), False)
        .otherwise(F.rlike(url, F.col("scope_re")))
    )
    return F.coalesce(decided, F.lit(False))


def in_scope_by_host(url: Column) -> Column:
    """Stricter variant: the URL's own host is the scope host or lies under it."""
    known, host = F.col("scope_host"), urls.url_host(url)
    under = F.col("scope_subs") & host.endswith(F.concat(F.lit("."), known))
    return F.coalesce((host == known) | under, F.lit(False))


def asset_in_scope(url: Column, include: str | None = None, include_domain: str | None = None) -> Column:
    """Script bodies may be fetched where either of the explicit scopes lets them; without one, where the row's scope does."""
    allowed = None
    if include is not None:
        allowed = F.rlike(url, F.lit(include))
    if include_domain is not None:
        own = F.rlike(url, F.concat(F.lit("^https?://"), text.quote_pattern(F.lit(include_domain)), F.lit(r"(?::\d+)?(?:/|\z)")))
        allowed = own if allowed is None else allowed | own
    return in_scope(url) if allowed is None else F.coalesce(allowed, F.lit(False))


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern contains; empty where that is not certain.

    Only what stands outside of groups, classes and alternatives counts, and nothing that may be repeated or left out.
    """
    runs, run, depth, at = [], "", 0, 0
    if "(?i" in pattern or re.search(r"\(\?[a-z]*[ix]", pattern) or "\\Q" in pattern:
        return ""
    while at < len(pattern):
        char, step, plain = pattern[at], 1, None
        if char == "\\":
            following = pattern[at + 1 : at + 2]
            if not following or following.isalnum():
                if following not in tuple("dDwWsSbBAzZ"):
                    return ""  # a numbered or named construct: leave it to the pattern itself
                step = 2
            else:
                step, plain = 2, following
        elif char == "[":
            end = pattern.find("]", at + 2)
            if end < 0 or "[" in pattern[at + 1 : end] or "&&" in pattern[at + 1 : end] or "\\" in pattern[at + 1 : end]:
                return ""
            step = end - at + 1
        elif char == "(":
            depth += 1
        elif char == ")":
            depth -= 1
        elif char == "|" and not depth:
            return ""
        elif char == "{":
            step = pattern.find("}", at) - at + 1
            if step <= 0:
                return ""
        elif char not in "^$.*+?|":
            plain = char
        following = pattern[at + step : at + step + 1]
        if plain is not None and not depth and following not in tuple("*?{"):
            run += plain
            if following == "+":
                runs.append(run)
                run = ""
        elif char not in "^" or run:
            runs.append(run)
            run = ""
        at += step
    return max([*runs, run], key=len)


GRAM = 4  # characters of a pattern's required literal that URLs are looked up by


def pattern_index(seeds: DataFrame) -> DataFrame:
    """``scope_re, gram``: each distinct pattern of the seeds' scopes with a piece that every URL in it contains."""
    patterns = seeds.where("scope_host is null and scope_re is not null").select("scope_re").distinct()

    def run(batches):
        for batch in batches:
            yield batch.assign(gram=[required_literal(p)[:GRAM] for p in batch["scope_re"]])

    return patterns.mapInPandas(run, "scope_re string, gram string")


def _pieces(url: str, size: int) -> Column:
    """All pieces of a URL that have so many characters."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.length(url) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(F.col(url), i, F.lit(size)))


def attach_by_pattern(rows: DataFrame, seeds: DataFrame, url: str = "url", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Pair rows with the seeds whose scope pattern their URL matches, on whatever host it lies.

    A pattern that replaces the scope holds everywhere, so hosts can't find its seeds. Instead each URL meets, in an
    equi-join on short pieces of text, the patterns that need a piece it contains, and only these
    run. A pattern without a certain piece meets every URL, which it would have to be run on anyway. Many seeds
    with one pattern cost one run.
    """
    index = materialized(pattern_index(seeds))
    sizes = sorted(r.n for r in index.select(F.length("gram").alias("n")).distinct().collect())  # GRAM + 1 at most
    if not sizes:
        return rows.join(seeds.select(*[c for c in seeds.columns if c not in rows.columns]), F.lit(False))
    keys = F.array_distinct(F.concat(*[_pieces(url, n) for n in sizes]))
    keyed = rows.withColumn("gram", F.explode(keys))
    met = lookup_join(keyed, index.withColumnRenamed("scope_re", "_pattern"), "gram", limit=limit).drop("gram")
    met = met.where(F.rlike(F.col(url), F.col("_pattern")))
    owners = seeds.where("scope_host is null").withColumn("_pattern", F.col("scope_re"))
    owners = owners.select("_pattern", *[c for c in seeds.columns if c not in rows.columns])
    return lookup_join(met, owners, "_pattern", limit=limit).drop("_pattern")


def redirect_allowed(target: Column, base_host: Column, subs: Column) -> Column:
    """A redirect hop stays on its base host, or under it when subdomains count."""
    host = urls.url_host(target)
    return (host == base_host) | (subs & host.endswith(F.concat(F.lit("."), base_host)))


def _attach_keys(host: Column) -> Column:
    count = F.least(F.size(F.split(host, r"\.")), F.lit(MAX_LABELS))
    suffixes = F.transform(
        F.sequence(F.lit(1), count),
        lambda n: F.concat(F.lit("d:"), F.call_function("substring_index", host, F.lit("."), -n)),
    )
    return F.concat(F.array(F.concat(F.lit("h:"), host)), suffixes)


def host_map(hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs of ``host`` and the seeds whose scope covers it, for the distinct hosts of a table.

    Hosts look themselves up under their name and each suffix of it, so the join yields the matching pairs
    and nothing else.
    """
    seeds = seeds.select(*[c for c in seeds.columns if c != "host"])
    hosts = hosts.select("host").where("host <> ''").distinct()
    keyed = hosts.withColumn("attach_key", F.explode_outer(_attach_keys(F.col("host"))))
    return lookup_join(keyed, seeds, "attach_key").drop("attach_key")


def attach_seeds(pages: DataFrame, seeds: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Pair each page with the seeds whose scope covers its host.

    ``pages`` needs ``host``; ``seeds`` comes from :func:`scope_rules`. A small seed table is broadcast to the
    suffixes of each page's host; a large one meets the distinct hosts first (:func:`host_map`), and only that map is joined to
    the pages. A stream has no distinct hosts yet and joins the table directly.
    """
    seeds = seeds.select(*[c for c in seeds.columns if c not in pages.columns])
    small = is_small(seeds, limit)
    if small or pages.isStreaming:
        keyed = pages.withColumn("attach_key", F.explode_outer(_attach_keys(F.col("host"))))
        return keyed.join(F.broadcast(seeds) if small else seeds, "attach_key").drop("attach_key")
    return lookup_join(pages, host_map(pages, seeds), "host", limit=limit)
