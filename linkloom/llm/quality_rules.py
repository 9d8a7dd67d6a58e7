"""Quality rules: fixed rules on counts, and a logistic regression over hashed word and character n-grams.

Words, pairs of neighbouring words and runs of CHARS characters are hashed into one table of weights. A text's evidence is
the mean weight of each of the three kinds, so long and short texts are judged alike. Weights are learned from a
bounded sample of labelled rows by AdaGrad; the evidence that out-of-fold weights give for the sample is turned
into probabilities by a logistic curve (Platt's calibration), with the sample weighted to the labels' real
shares. Rows are scored in Arrow batches against a fixed threshold.

* Words are runs of anything but space and control white space; lines end at line feeds. Null and empty texts
  have no words and fail the rule on length. Whole texts are read.
* Rows whose label is not 0 or 1 teach nothing; labels of one id that disagree count as 0. Equal texts count
  once. Without both labels the rules alone decide.
* Repeated rows are judged alike; ties are hashed alike. An empty table gives an empty result. Other columns
  are not looked at.
* Windows of three words are compared by 64-bit names of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.minmax_dedup import BASE, SPACE, mixed
from linkloom.llm.words import in_repeated_windows, word_names, word_spans

#: Rules: fewest words, and the greatest share (percent) of words in repeated windows of so many words.
LEAST_WORDS = 50
WINDOW, MOST_REPEATED = 3, 50
THRESHOLD = 0.5
#: Bound of the fit: labelled documents of each class.
SAMPLE_DOCS = 800
FOLDS = 4
#: Hashed features of each kind, and characters of a run.
SLOTS = 1 << 14
CHARS = 3
KINDS = 3
ROUNDS, RATE, DECAY = 12, 0.5, 1e-4
#: Evidence is a mean of weights; learning works on its multiple.
SCALE = 30.0

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point of a word.
LETTER = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text: bytes, raw: np.ndarray, names: np.ndarray) -> tuple[int, ...]:
    """The figures of COUNTS."""
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return (len(names), int(np.count_nonzero(LETTER[raw])), int(np.count_nonzero(SYMBOL[raw])), again, int(np.count_nonzero(in_repeated_windows(names, WINDOW))))


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def hashed(text: bytes, names: np.ndarray) -> list[np.ndarray]:
    """Slots of the words, of the pairs of words and of the runs of characters."""
    letters = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    runs = np.zeros(max(0, len(letters) - CHARS + 1), np.uint64)
    for i in range(CHARS):
        runs |= letters[i : i + len(runs)] << np.uint64(21 * i)
    pairs = mixed(names[:-1] + names[1:] * BASE)
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [((mixed(x) >> shift) + np.uint64(k * SLOTS)).astype(np.int64) for k, x in enumerate((names, pairs, runs))]


def read(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    return raw, word_names(raw, *word_spans(raw))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of every slot
    slope: float
    bias: float

    def probability(self, text: bytes, names: np.ndarray) -> float:
        """How likely the label 1 is."""
        evidence = sum(float(self.weights[slots].mean()) for slots in hashed(text, names) if len(slots))
        return float(1 / (1 + np.exp(-np.clip(self.slope * SCALE * evidence + self.bias, -40, 40))))


def clean_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of the ids that have a label."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))


def labelled(docs: DataFrame, clean: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``good, fold`` and the features of a bounded sample: of each class the ids that come first by their hash.

    A share of the hashes that holds four times the sample is cut off first, so what is sorted does not grow
    with the labels. The sample of ids is bounded, so it is broadcast.
    """
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = F.when(F.col("good") == 1, 4 * SAMPLE_DOCS / max(1, sizes.get(1, 0))).otherwise(4 * SAMPLE_DOCS / max(1, sizes.get(0, 0)))
    few = clean.withColumn("order", order).where(F.col("order") < most * (1 << 30))
    first = Window.partitionBy("good").orderBy("order", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS)
    chosen = chosen.select("doc_id", "good", (F.col("n") % FOLDS).cast("int").alias("fold"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "fold", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                slots, values, digests = [], [], []
                for text in part.column("text"):
                    data = text.as_py().encode()
                    kinds = [(*np.unique(own, return_counts=True), max(1, len(own))) for own in hashed(data, read(data)[1])]
                    slots.append(np.concatenate([slot for slot, _, _ in kinds]).astype(np.int32))
                    values.append(np.concatenate([times / n for _, times, n in kinds]).astype(np.float32))
                    digests.append(hashlib.sha256(data).digest())
                columns = [pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("doc_id", "good", "fold")] + columns, ["doc_id", "good", "fold", "slots", "values", "digest"])

    return rows.mapInArrow(run, "doc_id long, good int, fold int, slots array<int>, values array<float>, digest binary")


def learned(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights by AdaGrad over the rows ``(slots, values, good)``, both classes weighing the same."""
    weights, bias = np.zeros(KINDS * SLOTS), 0.0
    seen, seen_bias = np.full(KINDS * SLOTS, 1e-6), 1e-6
    share = {good: len(rows) / 2 / max(1, sum(r[2] == good for r in rows)) for good in (0, 1)}
    for turn in range(ROUNDS):
        for i in np.argsort(mixed(np.arange(len(rows), dtype=np.uint64) + np.uint64(turn * len(rows)))).tolist():
            slots, values, good = rows[i]
            z = float(np.clip(SCALE * (weights[slots] @ values) + bias, -40, 40))
            error = share[good] * (1 / (1 + np.exp(-z)) - good)
            step = error * SCALE * values + DECAY * weights[slots]
            seen[slots] += step * step
            weights[slots] -= RATE * step / np.sqrt(seen[slots])
            seen_bias += error * error
            bias -= RATE * error / np.sqrt(seen_bias)
    return weights


def calibrated(evidence: np.ndarray, good: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve through evidence that was not learned from, by Newton's method."""
    # Platt's targets keep the curve finite where the classes are apart.
    ones = good == 1
    target = np.where(ones, (ones.sum() + 1) / (ones.sum() + 2), 1 / ((~ones).sum() + 2))
    x, w = np.column_stack([evidence, np.ones(len(evidence))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grown = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(grown, x.T @ (share * (target - p)) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(sample: DataFrame, sizes: dict[int, int]) -> Model | None:
    """The model of a bounded sample; ``sizes`` are the labelled rows of each class that it stands for."""
    held = sorted(sample.collect(), key=lambda r: (r.doc_id, bytes(r.digest)))  # sorted here: in Spark the texts would be read twice
    # Equal texts count once, in one fold.
    rows = list({bytes(r.digest): (np.array(r.slots, np.int64), np.array(r["values"], np.float64), r.good, r.fold) for r in held}.values())
    if {r[2] for r in rows} != {0, 1}:
        return None
    evidence, good = np.zeros(len(rows)), np.array([r[2] for r in rows])
    for fold in range(FOLDS):
        rest = [r[:3] for r in rows if r[3] != fold]
        if {r[2] for r in rest} == {0, 1}:
            weights = learned(rest)
            for i, r in enumerate(rows):
                if r[3] == fold:
                    evidence[i] = SCALE * (weights[r[0]] @ r[1])
    share = np.array([sizes[g] / max(1, (good == g).sum()) for g in good])
    slope, bias = calibrated(evidence, good, share / share.mean())
    return Model(learned([r[:3] for r in rows]), slope, bias)


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    clean = clean_labels(labels)
    sizes = {r["good"]: r["count"] for r in clean.groupBy("good").count().collect()}  # two rows at most
    return fit(labelled(docs, clean, sizes), sizes) if set(sizes) == {0, 1} else None


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """Counts, rules and verdict of every row; ``probability`` is null where the rules alone decide."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights.astype(np.float32), model.slope, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared.value is None else Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column("text"):
                    data = (text.as_py() or "").encode()
                    raw, names = read(data)
                    found = counts(data, raw, names)
                    bad = failed(found[0], found[4])
                    likely = None if bad or known is None else known.probability(data, names)
                    rows.append((*found, bad, not bad and (likely is None or likely >= THRESHOLD), likely))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                columns = [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, JUDGED)


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judged(docs, trained(docs, table(spark, folder, "labels").select("doc_id", "quality")))
