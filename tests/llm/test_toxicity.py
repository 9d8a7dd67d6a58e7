import zlib

import pytest

from linkloom.llm import toxicity as T

PLAIN = "river stone window garden quiet letter travel summer basket music paper forest simple marble".split()
BAD = ["grobnik", "vileworm", "snarkled"]
DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int, text string"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture
def tables(rng):
    docs, labels = [], []
    for i in range(420):
        words = [rng.choice(PLAIN) + rng.choice(["", "s", "ly", "ed"]) for _ in range(rng.randrange(10, 90))]
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic), "x"))
    return docs, labels


def run(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).repartition(1).write.parquet(f"{tmp_path}/labels.parquet")
    return T.op10_toxicity(spark, str(tmp_path)).collect()


def test_held_out_documents_and_odd_rows(spark, tmp_path, tables):
    docs, labels = tables
    long_bad = " ".join(PLAIN * 3000 + BAD + PLAIN * 3000)
    docs = docs + [(900, None, "x"), (901, "", "x"), (902, "!!! 12 ---", "x"), (903, long_bad, "x"), (904, " ".join(PLAIN * 6000), "x"), docs[7], (None, "river", "x")]
    out = run(spark, tmp_path, docs, labels + [(5000, 0, 1, "x"), (8, 1, None, "x")])
    assert len(out) == len(docs)
    truth = {i: t for i, _, t, _ in labels}
    unseen = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(unseen) > 80 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    by_id = {r.doc_id: r for r in out}
    assert by_id[900].score == by_id[901].score < 0.3 and by_id[902].predicted == 0
    assert by_id[903].predicted == 1 and by_id[904].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == held(r.doc_id) for r in out if r.doc_id is not None)


def test_held_out_labels_teach_nothing(spark, tmp_path, tables):
    docs, labels = tables
    turned = [(i, q, 1 - t if held(i) else t, x) for i, q, t, x in labels]
    first, second = ({r.doc_id: r.score for r in run(spark, tmp_path / str(n), docs, rows)} for n, rows in enumerate((labels, turned)))
    assert first == second


def test_nothing_to_learn_from(spark, tmp_path):
    out = run(spark, tmp_path, [(1, "some words", "x")], [(1, 1, 0, "x")])
    assert [(r.score, r.predicted) for r in out] == [(0.0, 0)]
    assert run(spark, tmp_path / "empty", [], []) == []


def test_filter_keeps_clean_rows_with_all_columns(spark, tables):
    docs, labels = (spark.createDataFrame(rows, schema) for rows, schema in zip(tables, (DOCS, LABELS), strict=True))
    kept = T.without_toxic(docs, T.trained(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, _, t, _ in tables[1] if not t}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 3
