import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, score string"
WORDS = {
    "aa": "the quick brown fox jumps over lazy dogs while seven wise owls watch them from afar".split(),
    "bb": "der schnelle braune fuchs springt über den faulen hund und sieben weise eulen schauen zu".split(),
    "cc": "le renard brun rapide saute par dessus le chien paresseux pendant que sept hiboux observent".split(),
}


def documents(rng, n=240):
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(8, 60))), lang, "s", "x"))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_odd_rows(spark, folder_of, rng):
    rows = documents(rng)
    rows += [(900, None, "aa", "s", "x"), (901, "", None, "s", "x"), (902, "123 ½ ² --- 456", "bb", "s", "x"), (903, " ".join(WORDS["bb"] * 20000), None, None, "x"), rows[3]]
    out = L.op5_language_id(spark, folder_of("documents", rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    unseen = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(unseen) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    by_id = {r.doc_id: r for r in out}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903].lang_pred == "bb" and by_id[903].score > 0.99 and not by_id[903].rejected
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)


def test_held_out_labels_are_never_read(spark, folder_of, rng):
    rows = documents(rng)
    changed = [(i, t, "zz" if held(i) else lang, s, x) for i, t, lang, s, x in rows]
    first, second = (
        {r.doc_id: (r.lang_pred, r.score) for r in L.op5_language_id(spark, folder_of("documents", x, SCHEMA)).collect()} for x in (rows, changed)
    )
    assert first == second


def test_nothing_to_learn_from(spark, folder_of):
    assert L.op5_language_id(spark, folder_of("documents", [], SCHEMA, 1)).count() == 0
    only = L.op5_language_id(spark, folder_of("documents", [(1, "some text", None, None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in only] == [("und", 0.0, True)]


def test_narrow_margins_are_rejected(spark, rng):
    docs = spark.createDataFrame(documents(rng), SCHEMA)
    model = L.Classifier(L.fit(docs))
    mixed = " ".join(w for three in zip(*WORDS.values()) for w in three)
    assert model.predict("q")[2] and not model.predict(" ".join(WORDS["cc"]))[2]
    assert model.predict(mixed)[1] <= model.predict(" ".join(WORDS["cc"]))[1]
    assert model.predict("q")[1] == pytest.approx(1 / 3)
    assert docs.where(F.col("lang").isNull()).count() == 0
