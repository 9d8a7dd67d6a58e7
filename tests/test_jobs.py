"""Sinks that are run again, streams over many batches, bodies that are read late."""

import os

import pytest

from linkloom.operators import scope, sinks
from linkloom.plans import discovery
from linkloom.plans import queries as Q
from linkloom.session import scratch_path
from linkloom.sources import fixtures
from linkloom.streaming import jobs

from places import SMALL


def test_a_run_that_is_repeated_adds_nothing(spark):
    rows = [(f"[href] - https://a.com/{i}", "a_com") for i in range(500)] + [("[href] - https://b.com/1", "b_com")]
    lines = spark.createDataFrame(rows, "line string, host_key string")
    path = scratch_path(spark, "sink-test")
    for run in ("one", "one", "two"):
        sinks.append_by_host(lines, path, run, file_bytes=4096)
    back = sinks.read_by_host(spark, path)
    assert sorted((r.run, r.host_key, r["count"]) for r in back.groupBy("run", "host_key").count().collect()) == [
        ("one", "a_com", 500), ("one", "b_com", 1), ("two", "a_com", 500), ("two", "b_com", 1)
    ]
    # A large host has several files, a small one has one; one host's lines are read from its folders alone.
    files = [f for _, _, names in os.walk(f"{path}/run=one/host_key=a_com") for f in names if f.endswith(".txt")]
    assert 2 <= len(files) <= 5 and len([f for f in os.listdir(f"{path}/run=one/host_key=b_com") if f.endswith(".txt")]) == 1
    one = sinks.read_by_host(spark, path, "b_com")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(host_key" in one._jdf.queryExecution().executedPlan().toString()


def test_lines_of_no_host(spark):
    path = scratch_path(spark, "sink-test")
    sinks.append_by_host(spark.createDataFrame([("x", "a")], "line string, host_key string").where("false"), path, "one")


def test_frontier_batches_read_their_own_pages_only(spark, tmp_path, monkeypatch):
    """Twelve batches in two runs: as many input rows as each file has, earlier output is never read, each key comes once."""
    whole = spark.read.parquet(f"{SMALL}/pages.parquet")
    whole.repartition(12).write.parquet(f"{tmp_path}/all")
    files = sorted(f for f in os.listdir(f"{tmp_path}/all") if f.endswith(".parquet"))
    sizes = {f: spark.read.parquet(f"{tmp_path}/all/{f}").count() for f in files}
    os.makedirs(f"{tmp_path}/pages.parquet")
    seeds, visited = Q._host_seeds(Q._pages(spark, SMALL)), Q._visited(Q._pages(spark, SMALL))
    progress, finish = [], jobs._finish
    monkeypatch.setattr(jobs, "_finish", lambda *a: progress.extend(finish(*a)))
    for part in (files[:7], files[7:]):
        for f in part:
            os.link(f"{tmp_path}/all/{f}", f"{tmp_path}/pages.parquet/{f}")
        out = jobs.run_frontier(spark, f"{tmp_path}/pages.parquet", seeds, visited, fixtures.pages_rich, place=f"{tmp_path}/out", files_per_batch=1)
    read = [p.numInputRows for p in progress if p.numInputRows]
    assert sorted(read) == sorted(n for n in sizes.values() if n)
    keys = [(r.seed_id, r.key) for r in out.collect()]
    assert len(keys) == len(set(keys)) == Q.stream_frontier(spark, SMALL).count()


def test_bodies_meet_their_seeds_without_being_moved(spark):
    pages = Q._pages(spark, SMALL)
    bodies = discovery.in_scope_bodies(fixtures.pages_meta(pages), Q._host_seeds(pages), (1,))
    plan = bodies._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    # Fewer files than cores are dealt out by page id, and names of hosts are made distinct; nothing else moves, and no row is exploded.
    assert all("page_id" in line or "_host" in line for line in moved) and "Generate explode" not in plan
    assert {r.status for r in bodies.select("status").distinct().collect()} == {200}


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_bodies_with_few_and_many_seeds(spark, limit):
    pages = Q._pages(spark, SMALL)
    seeds = Q._host_seeds(pages)
    assert discovery.in_scope_bodies(pages, seeds, limit=limit).count() == Q.in_scope_pages(spark, SMALL).count()


def test_either_explicit_scope_lets_a_script_in(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("https://h.com/en/a.js",), ("https://d.org/b.js",), ("https://x.net/c.js",)], "url string")
    kept = rows.where(scope.asset_in_scope(F.col("url"), "/en/", "d.org"))
    assert [r.url for r in kept.collect()] == ["https://h.com/en/a.js", "https://d.org/b.js"]
