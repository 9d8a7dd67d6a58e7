import random
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, kept string, n_words long"
GAPS = " \t\n\v\f\r"


def brute(text):
    text = text or ""
    words = "".join(" " if c in GAPS else c for c in text).split(" ")
    words = [w for w in words if w]
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(GAPS):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


@pytest.fixture
def documents():
    rng = random.Random(9)
    good = [f"{a}{b}" for a in "bcdfgl" for b in ("a", "ei", "on", "é")]

    def prose(n):
        return "".join(rng.choice(good) + rng.choice([" ", " ", ", ", ".\n"]) for _ in range(n))

    def junk(n):
        return " ".join(rng.choice(good).upper() + rng.choice(["!!", "$$$", "|"]) for _ in range(n))

    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, (junk if bad else prose)(rng.randrange(60, 160)), "x", 1))
        labels.append((i, 0 if bad else 1, "t"))
    line = prose(8)
    odd = [None, "", " \n\t", "a\n" * 80, f"{line}\n" * 30, "x " * 500, "é ü \x1c " * 60, "z" * 300_000, "😀 " * 70, "a\vb\fc\rd " * 20, "a b c\n" + prose(60) + "\na b c"]
    rows += [(1000 + i, t, None, None) for i, t in enumerate(odd)]
    labels += [(0, 0, "t"), (1, None, "t"), (2, 7, "t"), (None, 1, "t"), (99_999, 1, "t")]
    return rows + rows[:3] + [(None, rows[1][1], "x", 1)], labels


def table_of(spark, folder_of, rows, labels):
    folder = folder_of("documents", rows, SCHEMA)
    spark.createDataFrame(labels, "doc_id long, quality int, text string").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_counts_agree_with_brute_force(spark, folder_of, documents):
    rows, labels = documents
    out = Q.op13_quality_rules(spark, table_of(spark, folder_of, rows, labels)).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert found == sorted(((d, *brute(t)) for d, t, *_ in rows), key=str)
    assert not any(r.kept for r in out if r.base_failed)
    verdict = {r.doc_id: r.kept for r in out}
    assert all(verdict[i] == bool(i % 4) for i in range(160) if not brute(dict((d, t) for d, t, *_ in rows)[i])[-1])


def test_held_out_rows_and_probabilities(spark):
    """Learned from half of the labelled documents at sf0.1, judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    half = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")
    model = Q.trained(docs, half)
    rest = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 2 = 1").select("doc_id", "quality")
    rows = Q.judged(docs, model).join(rest, "doc_id").where("not base_failed").collect()
    good = np.array([r.quality for r in rows])
    likely = np.array([r.probability for r in rows])
    assert ((likely >= Q.THRESHOLD) == (good == 1)).mean() > 0.97 and (good == 0).sum() > 50
    assert likely[good == 1].mean() > 0.9 and np.mean((likely - good) ** 2) < 0.05
    assert all(r.kept == (r.probability >= Q.THRESHOLD) for r in rows)


def test_rules_alone_without_both_labels(spark, folder_of, documents):
    rows, _ = documents
    out = Q.op13_quality_rules(spark, table_of(spark, folder_of, rows, [(1, 1, "")])).collect()
    assert all(r.kept == (not r.base_failed) and r.probability is None for r in out)


def test_no_rows(spark, folder_of):
    assert Q.op13_quality_rules(spark, table_of(spark, folder_of, [], [(1, 1, ""), (2, 0, "")])).count() == 0


def test_sample_is_bounded_before_it_is_sorted(spark):
    labels = spark.range(200_000).selectExpr("id as doc_id", "cast(id % 5 > 0 as int) as quality")
    clean = Q.clean_labels(labels)
    docs = spark.range(3).selectExpr("id as doc_id", "'a b' as text")
    plan = Q.labelled(docs, clean, {1: 160_000, 0: 40_000})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


