import numpy as np
import pytest

from linkloom.llm import bitslice_topk as B
from linkloom.llm import block_knn as K

SCHEMA = "vec_id long, embedding array<float>, score string, block long"


def vectors(n=420, width=12):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width)).astype(np.float32) * 0.2
    x[60:200] = x[60]  # one very common vector
    rows = [(i, [float(v) for v in x[i]], "x", 1) for i in range(n)]
    odd = [(1000, None, "x", 1), (1050, [None] + [0.5] * (width - 1), "x", 1), (1100, [float("nan")] * width, "x", 1), (1150, [float("inf")] * width, "x", 1)]
    odd += [(1200, [0.0] * width, "x", 1), (None, [0.1] * width, "x", 1), rows[7], rows[50], (2000, [0.125, 0.25, 0.5], "x", 1), (2001, [0.5, 0.25, 0.125], "x", 1), (2050, [], "x", 1)]
    return rows + odd


def brute(rows, by, k, score, zero):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]
    out = {}
    for q, a in good:
        if q % by == 0:
            found = sorted((-score(a, b), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def as_lists(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def integer(a, b):
    return int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int))


def double(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        total += x * y
    return total


@pytest.mark.parametrize("size", [16384, 50])
def test_top_k_agrees_with_brute_force(spark, folder_of, monkeypatch, size):
    monkeypatch.setattr(B, "ROWS_IN_BLOCK", size)
    monkeypatch.setattr(B, "QUERIES_IN_BLOCK", 3)
    rows = vectors()
    expected = {q: v for q, v in brute(rows, 50, 5, integer, True).items() if v}
    assert as_lists(B.op2_bitslice_topk(spark, folder_of("embeddings", rows, SCHEMA)).collect()) == expected


@pytest.mark.parametrize("size", [8192, 40])
def test_nearest_agrees_with_brute_force(spark, folder_of, monkeypatch, size):
    monkeypatch.setattr(K, "ROWS_IN_BLOCK", size)
    monkeypatch.setattr(K, "QUERIES_IN_BLOCK", 4)
    rows = vectors()
    expected = {q: v for q, v in brute(rows, 20, 20, double, False).items() if v}
    assert as_lists(K.op8_block_knn(spark, folder_of("embeddings", rows, SCHEMA)).collect()) == expected


def test_empty_tables_and_few_candidates(spark, folder_of):
    for query in (B.op2_bitslice_topk, K.op8_block_knn):
        assert query(spark, folder_of("embeddings", [], SCHEMA, 1)).count() == 0
        assert query(spark, folder_of("embeddings", [(100, [1.0], "x", 1), (7, [2.0], "x", 1)], SCHEMA)).count() == 1


def test_slices_add_up():
    rng = np.random.default_rng(1)
    rows = rng.integers(-90, 400, size=(131, 9))
    index = B.SlicedIndex(rows)
    for weights in rng.integers(-300, 300, size=(20, 9)):
        places, scores = index.top(weights, 131, np.array([], int))
        assert (scores == rows[places] @ weights).all() and sorted(places) == list(range(131))


def test_values_beyond_64_bits_are_refused():
    with pytest.raises(ValueError, match="too large"):
        B.quantised(np.full((1, 4), 1e20))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 40)) * rng.choice([1e-3, 1, 50], size=(300, 1)), rng.normal(size=(9, 40))
    found = K.survivors(K.Tile(q), K.Tile(x), np.zeros((9, 300), bool), 5)
    for i, places in enumerate(found):
        assert set(np.argsort(-(x @ q[i]))[:5]) <= set(places) and len(places) < 100
