"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

From a bounded sample of labelled documents two dictionaries are trained. Both hold ordinary text; the
toxic one ends with the pieces of words that toxic documents hold far more often than ordinary ones.
Each window of a few words is written with both. What the toxic dictionary saves in the windows of a
text, beyond what it saves in ordinary windows, is turned into a score by a logistic curve that is
calibrated on texts that the dictionaries had not seen.

* Null and empty texts have no windows; they score what a text without any saving scores.
* Whole texts are read; no window is left out, and saving is summed, so one bad passage in a long
  text counts as much as in a short one.
* Rows without a 0/1 label teach nothing. Without both labels everything scores 0.
* Repeated rows score alike, an empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import crc_remainder, lean, sliced, stored, table

#: The bound of the fit: labelled documents of each class, whose whole texts are learned from. Bytes of text that are taken apart at a time.
SAMPLE_DOCS = {1: 1000, 0: 2000}
SAMPLE_BYTES = 1 << 20
#: Letters of a piece of a word, at most.
PIECE_CHARS = 32
ORDINARY_BYTES = 12 * 1024
TOXIC_BYTES = 6 * 1024
FOLDS = 4

#: Words of a window, in two sizes; savings in bytes from which windows are counted.
WINDOW_WORDS = (1, 6)
SAVINGS = (1, 2, 3, 4, 5, 6)
PADDING = b"\0" * 48
THRESHOLD = 0.7
#: Both dictionaries are used with the same parameters; by level alone they would follow the dictionary's size.
PARAMETERS = {"window_log": 17, "chain_log": 16, "hash_log": 15, "search_log": 5, "min_match": 4, "target_length": 8}
#: Windows whose saving a task remembers, and how long these may be.
REMEMBERED = 200_000
REMEMBERED_CHARS = 128

WORD_OF = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD_OF.findall(text.lower()) if text else []


def windows(tokens: list[str], size: int) -> list[str]:
    """Runs of a few words, one after the other."""
    return tokens if size == 1 else [" ".join(tokens[i : i + size]) for i in range(0, len(tokens), size)]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, fold, text`` of a bounded sample: of each class the ids that come first by their hash.

    Labels of an id that disagree count as toxic. A share of the hashes that holds four times the sample is cut off
    before anything is sorted, and the sample of ids is bounded, so it is broadcast. Texts are whole; equal texts and
    repeated ids count once.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    clean = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in clean.groupBy("toxic").count().collect()}  # two rows at most
    most = {label: SAMPLE_DOCS[label] / max(1, sizes.get(label, 0)) for label in (0, 1)}
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = None
    for label in (0, 1):
        few = clean.withColumn("order", order).where((F.col("toxic") == label) & (F.col("order") < 4 * most[label] * (1 << 30)))
        first = few.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy("order", "doc_id"))).where(F.col("n") <= SAMPLE_DOCS[label])
        chosen = first if chosen is None else chosen.unionByName(first)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", (F.col("n") % FOLDS).alias("fold"))
    once = joined.groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text"))
    return once.groupBy("text").agg(F.min(F.struct("doc_id", "toxic", "fold")).alias("row")).select("row.*", "text")


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()  # of the constant and of each feature


def _pieces(tokens: set[str]) -> set[str]:
    """Words and the beginnings of words, with the spaces around them; none is longer than PIECE_CHARS."""
    return {" " + w[:n] for w in tokens for n in range(4, min(len(w), PIECE_CHARS) + 1)} | {f" {w} " for w in tokens if 2 < len(w) <= PIECE_CHARS}


def _toxic_pieces(here: Counter, there: Counter, toxic: int, ordinary: int, least: int = 5, odds: float = 60.0) -> list[str]:
    """Pieces that at least five toxic texts hold, sixty times as often as ordinary ones do; the most common last.

    A piece with which a longer one begins that is nearly as common is left to the longer one.
    """
    good = {p: n for p, n in here.items() if n >= least and n * ordinary >= odds * toxic * (there[p] + 0.5)}
    longer: Counter = Counter()
    for p, n in good.items():
        for cut in range(5, len(p)):
            longer[p[:cut]] = max(longer[p[:cut]], n)
    return sorted((p for p, n in good.items() if longer[p] < 0.9 * n), key=lambda p: (good[p], p))


class Scorer:
    """Both dictionaries, made ready for one task."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.coders = []
        for content in (model.ordinary, model.toxic):
            data = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**PARAMETERS, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
            data.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress)

    def saving(self, window: str) -> int:
        """Bytes that the toxic dictionary saves."""
        saved = self.known.get(window)
        if saved is None:
            content = PADDING + f" {window} ".encode()
            saved = len(self.coders[0](content)) - len(self.coders[1](content))
            if len(window) > REMEMBERED_CHARS:
                return saved
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[window] = saved
        return saved

    def features(self, text: str | None) -> list[float]:
        """For each size of window, how many save so many bytes at least; and the number of words; all as logarithms."""
        tokens = words(text)
        found = []
        for size in WINDOW_WORDS:
            counts = Counter(map(self.saving, windows(tokens, size)))
            found += [math.log1p(sum(n for saved, n in counts.items() if saved >= least)) for least in SAVINGS]
        return [*found, math.log1p(len(tokens))]

    def score(self, text: str | None) -> float:
        bias, *weights = self.model.weights
        z = bias + sum(w * f for w, f in zip(weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def _logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> tuple[float, ...]:
    """Weights by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _piece_counts(sample: DataFrame, sizes: dict[tuple[int, int], int], least: int, odds: float) -> list:
    """In how many texts of each class and fold a piece occurs: ``n<class><fold>``, for the pieces that can come into a dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SAMPLE_BYTES, 64):
            pieces, rows = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                found = _pieces(set(words(text)))
                pieces += found
                rows += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), *(part.column(n).take(pa.array(rows, pa.int32())) for n in ("toxic", "fold"))], ["piece", "toxic", "fold"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(lean(run), "piece string, toxic int, fold int")
    cells = [(label, fold) for label in (0, 1) for fold in range(FOLDS)]
    counts = rows.groupBy("piece").agg(*(F.count(F.when((F.col("toxic") == label) & (F.col("fold") == fold), 1)).alias(f"n{label}{fold}") for label, fold in cells))

    def total(label: int, without: int | None):
        return sum((F.col(f"n{label}{fold}") for fold in range(FOLDS) if fold != without), F.lit(0))

    good = F.lit(False)
    for without in (None, *range(FOLDS)):
        toxic, ordinary = (sum(n for (y, fold), n in sizes.items() if y == label and fold != without) for label in (1, 0))
        good |= (total(1, without) >= least) & (total(1, without) * ordinary >= odds * toxic * (total(0, without) + 0.5))
    return counts.where(good).collect()


def _openings(sample: DataFrame, size: int) -> list:
    """What each ordinary text gives to the dictionaries: its first words, so that all of them together have a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SAMPLE_BYTES, 64):
            opening = [(" " + " ".join(words(text)))[:size] for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("doc_id", "fold")), pa.array(opening, pa.string())], ["doc_id", "fold", "opening"])

    return sample.where("toxic = 0").select("doc_id", "fold", "text").mapInArrow(run, "doc_id long, fold int, opening string").collect()


def dictionaries(sample: DataFrame, least: int = 5, odds: float = 60.0) -> dict[int | None, Model]:
    """Both dictionaries of the whole sample (None) and of all folds but one; what has but one class is left out.

    Texts are read inside of tasks; what reaches the driver is bounded by the size of the dictionaries and by the
    pieces that meet the odds.
    """
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    held: dict[int | None, Model] = {}
    if {label for label, _ in sizes} != {0, 1}:
        return held
    rest = {without: tuple(sum(n for (y, fold), n in sizes.items() if y == label and fold != without) for label in (0, 1)) for without in (None, *range(FOLDS))}
    counts = _piece_counts(sample, sizes, least, odds)
    shares = {without: max(64, ORDINARY_BYTES // max(1, ordinary)) for without, (ordinary, _) in rest.items()}
    openings = sorted(_openings(sample, max(shares.values())), key=lambda r: r["doc_id"])
    for without, (ordinary, toxic) in rest.items():
        if not ordinary or not toxic:
            continue
        base = "".join(r["opening"][: shares[without]] for r in openings if r["fold"] != without).encode()[-ORDINARY_BYTES:]
        total = lambda row, label: sum(row[f"n{label}{fold}"] for fold in range(FOLDS) if fold != without)  # noqa: B023, E731
        here, there = (Counter({r["piece"]: total(r, label) for r in counts}) for label in (1, 0))
        found = _toxic_pieces(here, there, toxic, ordinary, least, odds)
        held[without] = Model(base, base + "".join(found).encode()[-TOXIC_BYTES:])
    return held


def fit(sample: DataFrame) -> Model | None:
    """Dictionaries of the sample; the curve from texts that the dictionaries they are judged by have not seen."""
    sample = stored(sample, "toxicity-sample")
    learnt = dictionaries(sample)
    if None not in learnt:
        return None
    shared = sample.sparkSession.sparkContext.broadcast({fold: (m.ordinary, m.toxic) for fold, m in learnt.items() if fold is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {fold: Scorer(Model(*content)) for fold, content in shared.value.items()}
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            found = [scorers[fold].features(t.as_py()) if fold in scorers else None for fold, t in zip(folds, batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    judged = sample.where(F.col("fold").isin([f for f in learnt if f is not None])).repartition(2 * FOLDS, "doc_id")
    rows = sorted(judged.mapInArrow(lean(run), "doc_id long, toxic int, features array<double>").collect(), key=lambda r: r["doc_id"])
    if {r["toxic"] for r in rows} != {0, 1}:
        return None
    return replace(learnt[None], weights=_logistic(np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], float)))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` for every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(0.0).alias("score"))
    return narrow.mapInArrow(_scores(docs, model, ["doc_id"]), "doc_id long, score double")


def _scores(docs: DataFrame, model: Model, keep: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], [*keep, "score"])

    return lean(run)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that score under the threshold, with all their columns."""
    if model is None:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    judged = rows.mapInArrow(_scores(docs, model, ["row"]), rows.select("row", F.lit(0.0).alias("score")).schema)
    return judged.where(F.col("score") < THRESHOLD).select("row.*")


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the rows that may be learned from; the others' labels are not read."""
    return fit(labelled(docs, labels.where(crc_remainder(F.col("doc_id"), 3) != 1)))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; a third of the ids is held out from learning."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, table(spark, folder, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
