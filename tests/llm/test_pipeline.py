import zlib
from collections import defaultdict

import pytest

import corpus_pipeline as C
from linkloom.llm import packing
from test_minmax_dedup import plain_set
from test_secret_scan import base_spans

PLAIN = "river stone window garden quiet letter travel summer basket music paper forest simple marble copper morning".split()
BAD = ["grobnik", "vileworm", "snarkled"]


@pytest.fixture
def tables(spark, tmp_path, rng):
    docs, labels = [], []
    for i in range(240):
        words = [rng.choice(PLAIN) + rng.choice(["", "s", "ly", "ed"]) for _ in range(rng.randrange(10, 90))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if i % 15 == 1:
            words.append("password=b7db7aa4a5fcc78305")
        docs.append((i, " ".join(words), "en", "abc"[i % 3], 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1] + (" again" if i % 2 else ""), "en", None, 0) for i in range(0, 60)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), docs


def test_each_stage_on_its_own_input(spark, tables, tmp_path_factory):
    folder, rows = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and dict(out.dtypes) == dict(docs.dtypes)
        path = str(tmp_path_factory.mktemp("stage")) + "/out"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    bad = {i for i, t, *_ in rows if t and sum(w in BAD for w in t.split()) >= 3}
    left = {r.doc_id for r in seen["toxicity"]}
    assert len(left & bad) <= 3 and len({r[0] for r in rows} - bad - left) <= 3

    sets = {r.doc_id: plain_set(r.text, 5) for r in seen["toxicity"]}
    gone = left - {r.doc_id for r in seen["near_dedup"]}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert gone and all(any(j < i and alike(sets[i], sets[j]) for j in sets) for i in gone)
    stay = [sets[r.doc_id] for r in seen["near_dedup"] if sets[r.doc_id]]
    assert not any(alike(a, b) for n, a in enumerate(stay) for b in stay[:n])

    before = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert len(before) == len(seen["secrets"]) and any(base_spans(t) for t in before.values())
    for r in seen["secrets"]:
        assert not base_spans(r.text) and (r.text == before[r.doc_id] or base_spans(before[r.doc_id]))

    words = lambda r: len((r.text or "").split())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in seen["secrets"]:
        sizes[r.source] += words(r)
    for r in seen["mixing"]:
        taken[r.source] += words(r)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())

    pieces = seen["packing"]
    ids = {r.doc_id: packing.Encoder(packing.vocabulary()) for r in pieces[:1]}
    encoder = next(iter(ids.values()))
    crc = sorted((r.doc_id, zlib.crc32(next(encoder.encode([r.text or ""])))) for r in seen["mixing"])
    assert crc == sorted((r.doc_id, r.ids_crc32) for r in pieces)


def test_run_gives_the_stages_rows(spark, tables):
    folder, _ = tables
    first, again = (sorted(map(tuple, C.run(spark, folder).select("doc_id", "length", "ids_crc32").collect())) for _ in range(2))
    assert first == again and first
