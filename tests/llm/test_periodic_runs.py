import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, runs string, start long"


def brute_lyndon(ranks):
    """Distance from each place to the next place whose suffix is smaller."""
    n = len(ranks)
    return [next((j for j in range(i + 1, n) if ranks[j:] < ranks[i:]), n) - i for i in range(n)]


def brute_runs(words, least=12):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(q % d == 0 and all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


sequences = st.lists(st.integers(0, 3), min_size=1, max_size=60)


@settings(max_examples=400, deadline=None)
@given(sequences)
def test_phase_one_gives_the_lyndon_array(values):
    ranks = [sorted(set(values)).index(v) for v in values]
    assert P.lyndon_lengths(ranks) == brute_lyndon(ranks)


@settings(max_examples=400, deadline=None)
@given(st.one_of(sequences, st.builds(lambda a, b, n, c: a + b * n + c, sequences, sequences, st.integers(1, 6), sequences)))
def test_runs_of_any_sequence(values):
    words = [b"w%d" % v for v in values]
    assert P.runs(np.array(values, np.uint64), words) == brute_runs(words)


def test_sequences_with_many_nested_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    for values in (b, thue[:600], [0] * 500, [0, 1] * 300, ([0] * 7 + [1]) * 40):
        assert P.runs(np.array(values, np.uint64)) == brute_runs(values)
    # Sums of this sequence collide, so equal sums must not be taken for equal words.
    assert P.runs(np.array(thue, np.uint64)) == [r for r in brute_runs(thue)]


@pytest.fixture
def documents():
    rng = random.Random(3)
    words = ["le", "la", "un", "dé", "très", "x"]

    def text(n, k=6):
        return " ".join(rng.choice(words[:k]) for _ in range(n))

    rows = [(i, text(rng.randrange(0, 120), rng.randrange(2, 7)), "x", i) for i in range(90)]
    rows += [(100 + i, f"{text(20)} {(text(rng.randrange(1, 15)) + ' ') * rng.randrange(2, 6)} {text(9)}", None, None) for i in range(60)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, " \t\n", "x", 1), (203, "a " * 3000, "x", 1), (204, "b" * 200_000, "x", 1)]
    rows += [(205, "a b " * 6, "x", 1), (206, "a b " * 5 + "a", "x", 1), (207, "a b c " * 12, "x", 1), (208, "A a " * 9, "x", 1)]
    return rows + [rows[3], rows[3], (None, "q r s " * 7, "x", 1), (None, None, None, None)]


def test_agrees_with_brute_force(spark, folder_of, documents):
    out = P.op11_periodic_runs(spark, folder_of("documents", documents, SCHEMA))
    found = sorted((tuple(r) for r in out.collect()), key=str)
    assert found == sorted((brute(d, t) for d, t, *_ in documents), key=str)
    assert sum(r[1] > 0 for r in found) > 40


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y")], "doc_id long, text string")
    row = P.periodic(docs).first()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "x a b c y"


def test_no_rows(spark, folder_of):
    assert P.op11_periodic_runs(spark, folder_of("documents", [], SCHEMA, 1)).count() == 0
