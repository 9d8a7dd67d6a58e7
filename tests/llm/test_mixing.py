from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, key string"


def documents(rng, n=900):
    names = ["a", "B", "é", None, "hot"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else names[rng.randrange(4)]
        rows.append((i, " ".join(["w"] * rng.randrange(0, 120)) if i % 50 else None, None, source, "x"))
    rows += [rows[5], rows[5], (None, "a\x0bb c", "en", "a", "y")]
    return rows


def expected_targets(rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w])
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in order}, sizes
        capped |= more


@pytest.mark.parametrize("bucket_rows", [8192, 20])
def test_targets_and_totals(spark, folder_of, rng, monkeypatch, bucket_rows):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(M, "FAN_IN", 4)
    rows = documents(rng)
    folder = folder_of("documents", rows, SCHEMA)
    out = M.op7_source_mix(spark, folder).collect()
    again = M.op7_source_mix(spark, folder).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert len(out) == len(rows) and all(key(r) for r in out)
    goals, sizes = expected_targets(rows)
    source = {i: s for i, _, _, s, _ in rows}
    taken = defaultdict(int)
    for r in out:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(goals[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 60.5, (s, taken[s], goal)


def test_rounding_keeps_expectations(spark):
    """Over many seeds each document is taken about as often as its fraction says."""
    import pandas as pd

    rows = pd.DataFrame({"doc_id": range(40), "size": [10 + 7 * (i % 5) for i in range(40)], "key": "sa", "source_size": 0, "target": 0.0, "bucket": 0, "buckets": 1, "whole": 0})
    rows["mass"] = rows["size"] * 0.3
    hits = sum((M._settled(rows, seed, 0).sort_values("doc_id")["mass"].to_numpy() > 0).astype(int) for seed in range(400))
    assert 0.27 < hits.mean() / 400 < 0.33 and hits.min() > 70 and hits.max() < 170


def test_edge_tables(spark, folder_of):
    assert M.op7_source_mix(spark, folder_of("documents", [], SCHEMA, 1)).count() == 0
    blank = M.op7_source_mix(spark, folder_of("documents", [(1, None, None, None, "k"), (2, " \t", None, "s", "k")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_repeats_rows_with_all_columns(spark, rng):
    docs = spark.createDataFrame(documents(rng), SCHEMA)
    out = M.mix(docs)
    assert out.columns == docs.columns
    words = M.sized(out).agg(F.sum("size")).first()[0]
    assert words == pytest.approx(1.5 * M.sized(docs).agg(F.sum("size")).first()[0], rel=0.02)
    assert out.groupBy("doc_id").count().where("count > 2 and doc_id <> 5").count() == 0
