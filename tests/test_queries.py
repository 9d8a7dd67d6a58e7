"""All registered queries of the core against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import differences, tables
from places import SMALL

CHECKED = sorted(contract.QUERIES)
# No URL of the test tables has one of the words; historical_endpoints_admin has.
EMPTY = ["historical_endpoints"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    more, less, ours, _ = differences(spark, tables(SMALL), SMALL, contract.queries()[name], contract.oracle_sql()[name])
    assert (more[:3], less[:3]) == ([], [])
    assert ours > 0 or name in EMPTY


def test_scripts_of_all_pages_are_scanned(spark):
    """One script per page: findings stand in bodies that the five scripts of an origin leave out, and agree with the SQL."""
    from linkloom.plans import queries as Q
    from linkloom.sources import fixtures

    pages = Q._pages(spark, SMALL)
    assert fixtures.page_scripts(pages).select("page_id").distinct().count() == pages.count() > fixtures.script_bodies(pages).count()
    name = "asset_quoted_links_whole"
    more, less, ours, _ = differences(spark, tables(SMALL), SMALL, contract.queries()[name], contract.oracle_sql()[name])
    assert (more[:3], less[:3]) == ([], []) and ours > contract.queries()["asset_quoted_links"](spark, SMALL).count()


def test_depths_of_deep_chains_without_a_limit(spark):
    name = "crawl_depths_unlimited"
    more, less, ours, _ = differences(spark, tables(SMALL), SMALL, contract.queries()[name], contract.oracle_sql()[name])
    assert (more[:3], less[:3]) == ([], []) and ours > contract.queries()["crawl_depths"](spark, SMALL).count()


def test_every_query_has_sql():
    assert set(contract.QUERIES) == set(contract.ORACLES)


@pytest.mark.parametrize("name", ["stream_findings", "stream_dedup", "stream_sink", "stream_frontier"])
def test_streams_read_folders_in_batches_and_go_on_after_a_stop(spark, tmp_path, name):
    """Pages in a folder of files, three batches, the last file only there at the second run."""
    from linkloom.plans import queries as Q
    from linkloom.sources import fixtures
    from linkloom.streaming import jobs

    whole = spark.read.parquet(f"{SMALL}/pages.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/all")
    files = sorted(f for f in os.listdir(f"{tmp_path}/all") if f.endswith(".parquet"))
    os.makedirs(f"{tmp_path}/pages.parquet")
    seeds = Q._host_seeds(Q._pages(spark, SMALL))
    more = [Q._visited(Q._pages(spark, SMALL))] if name == "stream_frontier" else []
    job = {"stream_findings": jobs.run_discovery, "stream_dedup": jobs.run_dedup, "stream_sink": jobs.run_host_sink, "stream_frontier": jobs.run_frontier}[name]
    for part in (files[:2], files[2:]):
        for f in part:
            os.link(f"{tmp_path}/all/{f}", f"{tmp_path}/pages.parquet/{f}")
        out = job(spark, f"{tmp_path}/pages.parquet", seeds, *more, fixtures.pages_rich, place=f"{tmp_path}/out", files_per_batch=1)
    keys = {"stream_findings": ["seed_id", "kind", "page_id", "output"], "stream_dedup": ["seed_id", "set_name", "key"], "stream_sink": ["host_key", "line"], "stream_frontier": ["seed_id", "url"]}[name]
    once = job(spark, f"{SMALL}/pages.parquet", seeds, *more, fixtures.pages_rich)
    if name == "stream_sink":  # of equal links the one that arrives first is written, so only their number is fixed
        out, once, keys = out.groupBy("host_key").count(), once.groupBy("host_key").count(), ["host_key", "count"]
    rows = [sorted(map(str, x.select(*keys).collect())) for x in (out, once)]
    assert rows[0] == rows[1] and rows[0]
