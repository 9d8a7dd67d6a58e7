import hashlib
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, spans string, k1 long"


def covered(texts, size):
    seen = Counter(t[p : p + size] for t in texts for p in range(len(t) - size + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = True
        starts = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if t else 0
        yield gone, int(gone.sum()), starts


def brute(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for (doc_id, *_), t, (gone, removed, spans), (_, *passages) in zip(rows, texts, covered(texts, S.LENGTH), covered(texts, S.PASSAGE), strict=True):
        left = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((doc_id, len(t), removed, spans, hashlib.sha256(left).hexdigest(), *passages))
    return sorted(out, key=str)


@pytest.fixture
def documents(rng):
    def text(n):
        return "".join(rng.choice("abcdefgh é\n") for _ in range(n))

    passages = [text(n) for n in (250, 255, 256, 257, 300, 360, 399, 400, 401, 420, 700, 1500)]
    whole = [text(n) for n in (300, 500, 900, 2500)]
    rows = []
    for i in range(70):
        kind = i % 7
        if kind == 0:
            body = rng.choice(whole)
        elif kind == 1:  # a near copy
            body = list(rng.choice(whole))
            body[rng.randrange(len(body))] = "X"
            body = "".join(body)
        else:
            body = text(rng.randrange(0, 600)) + rng.choice(passages) + text(rng.randrange(0, 300)) + rng.choice(passages) * rng.randrange(0, 3)
        rows.append((i, body, "x", 1))
    rows += [(100, None, "x", 1), (101, "", "x", 1), (102, "z" * 1200, "x", 1), (103, "ab" * 500, "x", 1), (104, "q" * 400, "x", 1), (105, text(400), None, None)]
    return rows + [rows[9]] * 5 + [(None, rows[12][1], "x", 1)]


@pytest.mark.parametrize(("segment", "remembered"), [(1 << 20, 100_000), (700, 3)])
def test_agrees_with_brute_force(spark, folder_of, documents, monkeypatch, segment, remembered):
    monkeypatch.setattr(S, "SEGMENT", segment)
    monkeypatch.setattr(S, "REMEMBERED", remembered)
    out = S.op3_suffix_dedup(spark, folder_of("documents", documents, SCHEMA)).collect()
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.passage_bytes, r.n_passages) for r in out), key=str)
    assert found == brute(documents)


def test_tables_without_rows_or_repeats(spark, folder_of):
    assert S.op3_suffix_dedup(spark, folder_of("documents", [], SCHEMA, 1)).count() == 0
    one = S.op3_suffix_dedup(spark, folder_of("documents", [(1, "short", "x", 1)], SCHEMA)).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.passage_bytes) for r in one] == [(5, 0, 0, 0)]


def test_a_passage_shorter_than_what_is_removed_is_reported(spark, folder_of, rng):
    passage, *own = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (50, 90, 90, 90))
    rows = [(1, f"{own[0]}\n{passage}\n", "x", 1), (2, f"{passage}\n{own[1]}", "x", 1), (3, own[2], "x", 1)]
    out = sorted(S.op3_suffix_dedup(spark, folder_of("documents", rows, SCHEMA)).collect())
    assert [r.n_removed for r in out] == [0, 0, 0]
    assert [(r.passage_bytes >= len(passage), r.n_passages) for r in out] == [(True, 1), (True, 1), (False, 0)]
