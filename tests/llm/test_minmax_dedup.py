import re

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import minmax_dedup as D
from linkloom.llm.components import components

SCHEMA = "doc_id long, text string, bands string, node long"


def plain_set(text, size=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.fixture
def documents(rng):
    vocabulary = [f"w{n}é" for n in range(300)]
    rows, next_id = [], 10
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 140))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((next_id * 7919 % 100003, " ".join(words), "x", 1))
            next_id += 1
    chain = [f"c{n}" for n in range(120)]
    for step in range(30):  # neighbours are alike, the ends are not
        rows.append((200000 - step, " ".join([f"new{n}" for n in range(step * 3)] + chain[step * 3 :]), "x", 1))
    odd = [None, "", " \t\n", "one two three", "ONE\x0btwo  Three", "one two", " ", "A" * 5000, "a " * 5000, "a " * 7000]
    rows += [(300000 + i, t, "x", 1) for i, t in enumerate(odd)]
    return rows + [rows[4], rows[4], (None, rows[4][1], "x", 1)] + [(400000 + i, rows[9][1].upper().replace("É", "é"), "x", 1) for i in range(40)]


@pytest.mark.parametrize("block", [256, 4])
def test_components_agree_with_brute_force(spark, folder_of, documents, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "COLUMNS", 64)
    out = D.op9_minmax_dedup(spark, folder_of("documents", documents, SCHEMA)).collect()
    assert len(out) == len(documents)
    expected, sizes = plain_components(documents), {i: len(plain_set(t)) for i, t, *_ in documents}
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (expected[r.doc_id], sizes[r.doc_id], expected[r.doc_id] == r.doc_id), r


def test_one_stays_of_each_group(spark, documents):
    docs = spark.createDataFrame(documents, SCHEMA)
    kept = D.without_copies(docs, size=4)
    assert kept.columns == docs.columns
    expected = plain_components(documents)
    assert {r.doc_id for r in kept.collect()} == set(expected.values()) | {None}


def test_rows_that_share_an_id_stay_once(spark):
    texts = [" ".join(f"{name}{n}" for n in range(20)) for name in "abcde"]
    rows = [(1, texts[0], "x", 1), (5, texts[0], "x", 1), (5, texts[1], "x", 1), (7, texts[1], "y", 2), (7, "", "x", 1)]
    rows += [(9, texts[2], "x", 1)] * 3 + [(9, texts[2], "a", 0), (11, texts[3], "x", 1), (11, "", "x", 1), (11, None, "x", 1), (12, texts[4], "x", 1), (11, texts[4], "x", 1)]
    rows += [(20, "", "x", 1)] * 2 + [(21, " ", "x", 1), (None, texts[2], "x", 1), (None, texts[2], "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = D.classes(docs.select("doc_id", "text")).collect()
    assert len(out) == len(rows)
    found = {i: {r.component_id for r in out if r.doc_id == i} for i in {r[0] for r in rows}}
    assert found == {1: {1}, 5: {1}, 7: {1}, 9: {9}, 11: {11}, 12: {11}, 20: {20}, 21: {21}, None: {None}}
    kept = sorted(((r.doc_id, r.text, r.bands, r.node) for r in D.without_copies(docs, size=4).collect()), key=str)
    assert kept == sorted([(1, texts[0], "x", 1), (9, texts[2], "a", 0), (11, texts[3], "x", 1), (20, "", "x", 1), (21, " ", "x", 1)] + [(None, texts[2], "x", 1)] * 2, key=str)


def test_every_row_that_stays_stays_once(spark, documents):
    kept = D.without_copies(spark.createDataFrame(documents, SCHEMA), size=4)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(plain_components(documents).values()))


def test_empty_table(spark, folder_of):
    assert D.op9_minmax_dedup(spark, folder_of("documents", [], SCHEMA, 1)).count() == 0


def test_signatures_estimate_similarity_and_segments_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    shared, a, b = rng.integers(0, 2**62, (3, 400)).astype(np.uint64)
    x, y = np.unique(np.concatenate([shared, a[:100]])), np.unique(np.concatenate([shared, b[:100]]))
    s = D.min_max([x, y], 600)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.05
    texts = pa.array([f"word{i} and more of it {i * i} é" for i in range(50)] + [None, ""])
    whole = [v.tolist() for v in D.sets_of(texts, 4)]
    monkeypatch.setattr(D, "SEGMENT", 64)
    assert whole == [v.tolist() for v in D.sets_of(texts, 4)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 600)] + [(7, 9), (9, 8)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 600)}, 7: 7, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
