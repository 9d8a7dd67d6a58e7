"""Language identification by compression with one zstandard dictionary per language.

A raw-content dictionary of each language is cut from a bounded sample of labelled documents. A text
is written in pieces with each dictionary; the language whose pieces are shortest in sum wins, and
the text is called rejected when the runner-up needs hardly more bytes.

* Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was learned.
* Equal lengths go to the language that sorts first; such a text has margin 0 and is rejected.
* Whole texts are read, in pieces of bounded size. Repeated rows get equal answers; an empty table gives
  an empty result; other columns of the table are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import crc_remainder, table

#: The bounds of the fit: documents of a language, characters of each, bytes of all dictionaries together.
SAMPLE_DOCS = 16
SAMPLE_CHARS = 1024
DICTIONARY_BYTES = 16 * 1024
ALL_BYTES = 16 * 1024 * 1024

#: Characters of one piece; zstandard level; a margin in bytes per hundred below which a text is rejected.
PIECE_CHARS = 1024
LEVEL = 6
NARROW = 0.4
#: What each piece begins with: one match in every language, so that short pieces aren't stored as they are.
PADDING = b"\0" * 160
#: Bytes that make one language e times as likely as another, for the score.
TEMPERATURE = 6.0

NO_WORD = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower case, each run of anything but letters as one space."""
    return NO_WORD.sub(" ", text.lower())


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language from ``(doc_id, text, lang)``; rows without language or letters are left out.

    Of each language, the documents that come first by a hash of their id and text give one passage
    from their middle each. Only that bounded sample leaves the executors.
    """
    at = F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    cut = labelled.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").substr(at, F.lit(SAMPLE_CHARS)).alias("passage"), F.xxhash64("doc_id", "text").alias("place")
    )
    order = Window.partitionBy("lang").orderBy("place", "passage")
    rows = cut.where(F.col("passage").rlike(r"\p{L}")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS).collect()
    passages: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, -r.n)):
        passages.setdefault(r.lang, []).append(normal(r.passage))
    room = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(passages)))
    return {lang: " ".join(parts).encode()[-room:] for lang, parts in passages.items()}


class Classifier:
    """The dictionaries, made ready for one task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = []
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang].rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append((lang, zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether the margin is too narrow to trust."""
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        whole = normal(text)
        pieces = [whole[i : i + PIECE_CHARS].encode() for i in range(0, len(whole), PIECE_CHARS)]
        sizes = [sum(len(coder.compress(PADDING + p)) for p in pieces) for _, coder in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        score = 1 / sum(math.exp((sizes[best] - s) / TEMPERATURE) for s in sizes)
        rest = sorted(sizes)[1:2]
        return self.coders[best][0], score, bool(rest) and (rest[0] - sizes[best]) * 100 < NARROW * len(whole)


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; a quarter of the ids is held out from learning."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    found = classify(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
