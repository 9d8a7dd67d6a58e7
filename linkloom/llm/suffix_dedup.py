"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Whether the LENGTH bytes from a position occur anywhere else is found by ranking pieces that grow until
they are unique or LENGTH bytes long; the same rounds find the strings of PASSAGE bytes that do, which are
reported and not removed. Ranking every byte of a corpus would shuffle many times its size, so
positions are sampled first in a way that loses nothing: of all GRAM-byte pieces inside the first PASSAGE
bytes of a string the one with the least hash is its anchor, and equal strings have equal anchors at equal
distances. A string is then a pair (anchor, distance before it), and strings with one anchor lie side by side.

Each round sorts anchors by the rank of the piece that all strings of a range of distances share. An
anchor whose piece is unique is done: none of its strings repeats. One whose whole surroundings occur
twice is done as well: all of its strings repeat. For the rest the range is split, the shared piece grows
at both ends, and the larger pieces are named from their bytes and ranked again, until they are whole
strings. Only the borders of repeats go that far. Equal surroundings go on as one row, however many there are.

* Null texts are empty. Texts shorter than LENGTH keep all bytes, those shorter than PASSAGE hold no passage.
  Matches never cross documents.
* Strings are judged on the input, overlaps count, and a string may repeat inside its own document.
* Repeated rows are occurrences of their own; equal texts share one result, found by a digest of the text.
  A task ranks a text that it meets often but twice: two occurrences are as good as many.
* Whole texts are read, very long ones in segments that overlap. An empty table gives an empty result.
* Ranks are 128-bit names, made of two independent 64-bit hashes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, lean, stored, table, text_buffers
from linkloom.llm.minmax_dedup import mixed

LENGTH = 400
#: Passages of fifty words have some 250 to 400 bytes, so strings of LENGTH bytes do not show all of them.
PASSAGE = 256
GRAM = 64
#: Distances from a string's start to its anchor, and the widths of the ranges of distances, round by round; each but the first is a multiple of the next.
DISTANCES = PASSAGE - GRAM + 1
WIDTHS = (DISTANCES, 49, 7, 1)
SEGMENT = 1 << 20
PLACE_BITS = 24

ONE, TWO = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
FACTOR = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

#: Digests of texts that a task remembers; a text forgotten is ranked again, which changes no result.
REMEMBERED = 100_000

KEY = "k1 long, k2 long, at long, far int"
ROWS = KEY + ", size int, lo int, hi int, open boolean, piece long, name long"
FIRST = "k1 long, k2 long, at long, hi int, lo int, lo_long int, piece long, name long, name_long long"


class Names:
    """64-bit names of any pieces of a buffer, from running sums."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray, values: np.ndarray):
        n = len(raw) + 1
        if len(Names.powers) < n:
            for name, factor in (("powers", FACTOR), ("inverses", INVERSE)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(Names, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[raw] * Names.powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Names.inverses[start])

    def grams(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * Names.inverses[: len(self.sums) - size])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, values[-1], np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts in one buffer: which text, place, greatest distance, least distances for both sizes, name of the piece and of both surroundings."""
    one, two = Names(raw, ONE), Names(raw, TWO)
    grams = one.grams(GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = least_in_windows((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), DISTANCES)
    counts = np.minimum(ends - starts - PASSAGE + 1, SEGMENT)
    text = np.repeat(np.arange(len(starts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    at = (least[first] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    place, text, begin, end = at[new], text[new], first[new], first[last]
    hi, lo = place - begin, place - end
    end_long = np.minimum(end, ends[text] - LENGTH)
    lo_long = np.where(end_long >= begin, place - end_long, hi + 1)  # beyond hi: no string of LENGTH bytes begins here
    name = mixed(two.of(begin, end + PASSAGE) + _ranges(lo, hi))
    name_long = mixed(two.of(begin, np.maximum(end_long, begin - LENGTH) + LENGTH) + _ranges(lo_long, hi))
    return text, place, hi, lo, lo_long, grams[place], name, name_long


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mixed((lo * 1024 + hi + 1).astype(np.uint64))


def met(seen: dict[tuple[int, int], int], key: tuple[int, int]) -> int:
    """How often a task has met a text, this time included, as far as it remembers."""
    if len(seen) >= REMEMBERED and key not in seen:
        seen.clear()
    seen[key] = seen.get(key, 0) + 1
    return seen[key]


def first_round(docs: DataFrame) -> DataFrame:
    """One row for each anchor of ``docs (k1, k2, text)``, with what strings of both sizes need."""

    def emit(parts: list, raw: list) -> pa.RecordBatch:
        lengths = np.array([len(r) for r in raw])
        ends = np.cumsum(lengths)
        text, place, hi, lo, lo_long, *names = anchors(np.concatenate(raw), ends - lengths, ends)
        k1, k2, base = (np.array(c, np.int64)[text] for c in zip(*parts, strict=True))
        columns = [k1, k2, base + place - (ends - lengths)[text], *(c.astype(np.int32) for c in (hi, lo, lo_long)), *(c.view(np.int64) for c in names)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "at", "hi", "lo", "lo_long", "piece", "name", "name_long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, raw, held, seen = [], [], 0, {}
        for batch in batches:
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            for data, bounds in text_buffers(batch.column("text")):
                for i in np.flatnonzero(np.diff(bounds) >= PASSAGE).tolist():
                    if met(seen, (k1[i], k2[i])) > 2:
                        continue
                    whole = data[bounds[i] : bounds[i + 1]]
                    for at in range(0, len(whole) - PASSAGE + 1, SEGMENT):
                        cut = whole[at : at + SEGMENT + LENGTH - 1]
                        parts.append((k1[i], k2[i], at))
                        raw.append(cut.copy())
                        held += len(cut)
                        if held >= SEGMENT:
                            yield emit(parts, raw)
                            parts, raw, held = [], [], 0
        if raw:
            yield emit(parts, raw)

    return docs.mapInArrow(lean(run), FIRST)


def next_round(rows: DataFrame, level: int) -> DataFrame:
    """Split the ranges of ``rows`` (with the bytes around their anchors) and name the larger pieces."""
    outer, width = WIDTHS[level - 1], WIDTHS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                binary = part.column("around").cast(pa.large_binary())
                bounds = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
                raw = np.frombuffer(binary.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
                lo, hi, far, size = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "far", "size"))
                base = lo // outer * outer
                first, last = (lo - base) // width, (hi - base) // width
                times = last - first + 1
                row = np.repeat(np.arange(len(lo)), times)
                number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[row]
                near = base[row] + number * width
                end = np.minimum(np.minimum(near + width - 1, base[row] + outer - 1), DISTANCES - 1)
                own_lo, own_hi = np.maximum(lo[row], near), np.minimum(hi[row], end)
                anchor = (bounds[:-1] - bounds[0] + far)[row]
                one, two = Names(raw, ONE), Names(raw, TWO)
                piece = mixed(one.of(anchor - near, anchor - end + size[row]) + _ranges(near, end))
                name = mixed(two.of(anchor - own_hi, anchor - own_lo + size[row]) + _ranges(own_lo, own_hi))
                taken = [part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("k1", "k2", "at", "far", "size")]
                columns = [*taken, own_lo.astype(np.int32), own_hi.astype(np.int32), part.column("open").to_numpy(zero_copy_only=False)[row].astype(bool), piece.view(np.int64), name.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "at", "far", "size", "lo", "hi", "open", "piece", "name"])

    return rows.select("k1", "k2", "at", "far", "size", "lo", "hi", "open", "around").mapInArrow(lean(run), ROWS)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.where("open").select("k1", "k2", "size", (F.col("at") - F.col("hi")).alias("begin"), (F.col("at") - F.col("lo") + F.col("size")).alias("end"))


def ranked_first(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the first round whose piece is not alone, one for each size, and whether the surroundings differ in any way.

    Where they do not, strings of LENGTH bytes cover what those of PASSAGE bytes would, unless a text ends before.
    """
    rows = rows.withColumn("names", F.xxhash64("name", "name_long"))
    ranks = rows.groupBy("piece").agg(F.count("*").alias("n"), F.min("names").alias("low"), F.max("names").alias("high"))
    near = rows.join(scratch.stored(ranks.where("n > 1"), "suffix-ranks"), "piece")

    def of(size: int, end: str) -> Column:
        piece = F.when(F.col("differ"), F.xxhash64("piece", F.lit(size)))
        name = F.when(F.col("differ"), F.col("name" + end))
        return F.struct(F.lit(size).alias("size"), F.col("lo" + end).alias("lo"), F.lit(True).alias("open"), piece.alias("piece"), name.alias("name"))

    near = near.withColumn("differ", F.col("low") < F.col("high"))
    both = near.select("k1", "k2", "at", F.col("hi").alias("far"), "hi", "differ", (F.col("lo") == F.col("lo_long")).alias("same"), F.inline(F.array(of(PASSAGE, ""), of(LENGTH, "_long"))))
    return both.where((F.col("lo") <= F.col("hi")) & (F.col("differ") | ~F.col("same") | (F.col("size") == LENGTH))).drop("same")


def ranked(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose piece is not alone, and whether the surroundings differ; ranks are a table, so that Spark can split a hot piece."""
    ranks = rows.groupBy("piece").agg(F.count("*").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"), F.max("open").alias("asked"))
    return rows.join(scratch.stored(ranks.where("n > 1 and asked"), "suffix-ranks"), "piece").select(*rows.columns, (F.col("low") < F.col("high")).alias("differ"))


def settle(shared: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The spans that certainly repeat, and the rows that stay undecided, one for each equal surroundings."""
    shared = scratch.stored(shared, "suffix-shared")
    rest = ["k1", "k2", "at", "far", "size", "lo", "hi"]
    kinds = shared.where("differ").groupBy("piece", "name").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct(*rest)).alias("row"))
    kinds = scratch.stored(kinds.select("piece", "name", "n", (F.col("open") & (F.col("n") == 1)).alias("open"), "row"), "suffix-kinds")
    twice = shared.where("differ and open").join(kinds.where("n > 1").select("piece", "name"), ["piece", "name"])
    asked = kinds.groupBy("piece").agg(F.max("open").alias("open"), F.count("*").alias("n")).where("open and n > 1").select("piece")
    undecided = kinds.join(asked, "piece", "left_semi").select("row.*", "open")
    return _spans(shared.where("not differ")).unionByName(_spans(twice)), undecided


def settle_last(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The spans that repeat, when pieces are whole strings and both hashes name the same bytes."""
    ranks = rows.groupBy("piece", "name").agg(F.count("*").alias("n"), F.max("open").alias("asked"))
    ranks = scratch.stored(ranks.where("n > 1 and asked"), "suffix-ranks")
    return _spans(rows.join(ranks, ["piece", "name"]).select(*rows.columns))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the digest of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(LENGTH), "text").alias("k2"))


def surroundings(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The bytes around each anchor of ``rows``, cut once for both sizes from the texts: ``KEY, around``."""
    wanted = scratch.stored(rows.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "far", (F.col("size") - F.col("lo")).alias("reach"))).alias("places")), "suffix-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, (k1, k2) in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
                if met(seen, (k1, k2)) > 1:  # a copy, whose bytes were cut
                    continue
                text = batch.column("text")[i].as_py().encode()
                ends: dict[tuple[int, int], int] = {}
                for p in batch.column("places")[i].as_py():
                    place = p["at"], p["far"]
                    ends[place] = max(ends.get(place, 0), p["at"] + p["reach"])
                for (at, far), end in ends.items():
                    for to, value in zip(out, (k1, k2, at, far, text[at - far : end]), strict=True):
                        to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["k1", "k2", "at", "far", "around"])

    cut = docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).mapInArrow(lean(run), KEY + ", around binary")
    return cut.dropDuplicates(["k1", "k2", "at", "far"])


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``k1, k2, size, begin, end``: spans of texts, by their digest, that are covered by repeated strings of that size.

    Spans come more than once where texts do, and what strings of LENGTH bytes cover is not given again for PASSAGE.
    """
    rows = scratch.stored(first_round(docs.select("k1", "k2", "text")), "suffix-anchors")
    spans, undecided = settle(ranked_first(rows, scratch), scratch)
    scratch.drop("suffix-anchors", "suffix-ranks")
    found = [spans]
    around = scratch.stored(surroundings(docs, undecided, scratch), "suffix-around")
    for level in range(1, len(WIDTHS)):
        rows = scratch.stored(next_round(undecided.join(around, ["k1", "k2", "at", "far"]), level), f"suffix-round-{level}")
        if level == len(WIDTHS) - 1:
            found.append(settle_last(rows, scratch))
        else:
            spans, undecided = settle(ranked(rows, scratch), scratch)
            scratch.drop(f"suffix-round-{level}", "suffix-ranks")
            found.append(spans)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def kept(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_bytes, n_passages, kept`` for every row.

    ``kept`` are the remaining bytes; ``passage_bytes`` counts the bytes covered by repeated strings of PASSAGE bytes,
    in ``n_passages`` maximal runs. Removed bytes are among them.
    """
    rows = keyed(docs)
    large = F.octet_length("text") >= PASSAGE
    scratch = Scratch(docs.sparkSession)
    spans = repeats(rows.where(large), scratch).groupBy("k1", "k2").agg(F.collect_set(F.struct("size", "begin", "end")).alias("spans"))
    spans = stored(spans, "suffix-spans")  # no aggregate beside the join, so that a hot text can be split
    scratch.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for i in range(batch.num_rows):
                text, all_spans = batch.column("text")[i].as_py().encode(), batch.column("spans")[i].as_py() or []
                gone, passages = (merged([s for s in all_spans if s["size"] >= size]) for size in (LENGTH, PASSAGE))
                edges = [0, *(x for span in gone for x in span), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                values = (len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), sum(b - a for a, b in passages), len(passages), left)
                for to, value in zip(out, values, strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_bytes", "n_passages", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    joined = rows.where(large).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    whole = rows.where(~large).select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_bytes long, n_passages long, kept binary"
    return joined.unionByName(whole).mapInArrow(run, schema)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated strings take from every document."""
    return kept(table(spark, folder, "documents").select("doc_id", "text")).drop("kept")
