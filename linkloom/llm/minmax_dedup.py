"""Near-duplicates by min-max hashing, with every link confirmed on full shingle sets.

A document's shingles are hashed once under each permutation; both the least and the greatest value are
kept, so half as many permutations fill a signature. Bands of the signature name buckets. Documents with
equal sets are one class from the start. In each bucket the class with the smallest id is compared with the
others; confirmed links give components. The buckets that then still hold several components are compared
in full, in blocks of bounded size, inside of tasks: no rows of pairs are made, and what is in one
component already is not compared again.

* Words are runs of anything but space and control white space; A-Z count as a-z. Fewer words than a
  shingle has are one shingle. Without words a document has no shingle and is its own component.
* Null texts are empty. Rows without an id take no part: no component, kept.
* Repeated rows are one class. Rows that share an id count as one node with the links of all of them, and
  have one component; ``kept`` speaks of the id.
* Texts are read whole. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, lean, sliced, stored, table, text_buffers
from linkloom.llm.components import components
from linkloom.operators.joins import lookup_join

WORDS_IN_SHINGLE = 4
PERCENT = 80
#: 64 permutations give 128 values; 25 bands of five miss a pair of similarity 0.8 five times in 100,000.
PERMUTATIONS = 64
BAND = 5
#: Bytes that are hashed at a time, and bytes of the sets that a task remembers while it confirms links.
SEGMENT = 1 << 21
REMEMBERED_BYTES = 32 << 20
#: Members of one block of a bucket on average, and shingles that are multiplied out at a time.
BLOCK = 256
COLUMNS = 8192

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * BASE
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words before each text, for texts that lie one after the other."""
    gap = SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    inside = ~gap
    starts = np.flatnonzero(inside & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    # A word's value is a polynomial of its bytes, last byte first power, by sums along the whole buffer.
    power = _powers(int((ends - starts).max()) + 1) if len(starts) else np.ones(1, np.uint64)
    back = np.zeros(len(raw), np.int64)
    if len(starts):
        lengths = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        back = at - np.repeat(starts, lengths)
        terms = BYTE[LOWER[raw[at]]] * power[back]
        hashes = mixed(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(raw, bounds)
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64))
    rows = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        rows += words[i : i + len(rows)] * factors[i]
    rows = mixed(rows)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rows[a : b - size + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(rows[:0])
    return out


def segments(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts that have about SEGMENT bytes together."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SEGMENT, "right")) - 1)
        yield a, b
        a = b


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for raw, bounds in text_buffers(column):
        for a, b in segments(bounds):
            yield from shingle_sets(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)


def min_max(sets: list[np.ndarray], permutations: int = PERMUTATIONS) -> np.ndarray:
    """Least and greatest value of each non-empty set under each permutation: a row of 2 * permutations values for each set."""
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    seeds = mixed(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * BASE)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for p in range(permutations):
        turned = values * (seeds[2 * p] | np.uint64(1)) + seeds[2 * p + 1]
        turned ^= turned >> np.uint64(31)
        out[:, 2 * p] = np.minimum.reduceat(turned, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(turned, starts)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each band of each signature; the band's number is part of it."""
    bands = signatures.shape[1] // BAND
    parts = signatures[:, : bands * BAND].reshape(len(signatures), bands, BAND)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands)).copy()
    for i in range(BAND):
        key = mixed(key * ODD + parts[:, :, i])
    return key.view(np.int64)


SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>"


def signed(docs: DataFrame, size: int) -> DataFrame:
    """Set size, digest of the set and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text", SEGMENT, 512):
            sets = list(sets_of(part.column("text"), size))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            low, high = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if full:
                some = [sets[i] for i in full]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
                values = np.concatenate(some)
                low[full], high[full] = np.add.reduceat(mixed(values + ODD), starts), np.add.reduceat(mixed(values ^ BASE), starts)
                for i, row in zip(full, band_keys(min_max(some)), strict=True):
                    keys[i] = row
            columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "low", "high", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SIGNED)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[tuple, np.ndarray] = OrderedDict()
        held = 0

        def full(key: int, column: pa.Array, i: int) -> np.ndarray:
            nonlocal held
            # Rows that share an id may differ in text, so the text's hash is part of the key.
            text = column[i].as_py()
            found = known.get((key, hash(text)))
            if found is None:
                found = known[(key, hash(text))] = next(sets_of(pa.array([text], pa.string()), size))
                held += found.nbytes
                while held > REMEMBERED_BYTES and len(known) > 1:
                    held -= known.popitem(last=False)[1].nbytes
            return found

        for batch in batches:
            good = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i in range(batch.num_rows):
                x, y = full(a[i], batch.column("a_text"), i), full(b[i], batch.column("b_text"), i)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(common and 100 * common >= percent * (len(x) + len(y) - common))
                else:
                    good.append(False)
            yield batch.select(["a", "b"]).filter(pa.array(list(map(bool, good)), pa.bool_()))

    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(lean(run), "a long, b long")


def _compared(size: int, percent: int):
    """Links between members of different components in one block of a bucket, or between two blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = list(sets_of(pa.array(rows["text"], pa.string()), size))
        lengths = np.array([len(s) for s in sets], np.float32)
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), lengths.astype(int))
        shared = held[column] > 1  # a shingle that one member holds is in no intersection
        number = np.cumsum(held > 1) - 1
        row, column = row[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            common += part @ part.T
        block, root, node = (rows[c].to_numpy() for c in ("block", "root", "node"))
        alike = 100 * common >= percent * (lengths[:, None] + lengths[None, :] - common)
        alike &= root[:, None] != root[None, :]
        if rows["one"].iloc[0] != rows["two"].iloc[0]:
            alike &= block[:, None] != block[None, :]
        joined: dict[int, int] = {}

        def top(r: int) -> int:
            while r in joined:
                r = joined[r]
            return r

        links = []
        for i, j in np.argwhere(np.triu(alike, 1)).tolist():
            x, y = sorted((top(int(root[i])), top(int(root[j]))))
            if x != y:  # one link is enough to join two components
                joined[y] = x
                links.append((node[i], node[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _among(apart: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join components inside a bucket, found without making rows of pairs.

    Members of a bucket are dealt into blocks of about BLOCK, and every two blocks of a bucket meet
    in one bounded group. Buckets with the same members are looked at once.
    """
    held = apart.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node") % 1000003).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"))
    once = held.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = apart.join(once, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", "node", "root", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    rows = met.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    return rows.groupBy("bucket", "one", "two").applyInPandas(_compared(size, percent), "a long, b long")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component's root, of the buckets that hold more than one component."""
    labelled = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    apart = labelled.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket")
    return stored(labelled.join(apart, "bucket"), "minmax-apart")


def _shared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, node`` of the ids whose rows have different sets: the nodes of all of them."""
    key = F.struct("n_shingles", "low", "high")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least <> most")
    several = stored(several.select("doc_id"), "minmax-several")
    found = rows.where("n_shingles > 0").select("doc_id", "low", "high", "n_shingles")
    found = lookup_join(found, several, "doc_id").distinct()
    return found.join(nodes.select("low", "high", "n_shingles", "node"), ["low", "high", "n_shingles"]).select("doc_id", "node").distinct()


def classes(docs: DataFrame, size: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(signed(docs, size), "minmax-signed")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    equal = known.groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = stored(equal, "minmax-nodes")
    spread = nodes.select(F.explode("bands").alias("bucket"), "node").distinct()
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    members = stored(spread.join(shared, "bucket").select("bucket", "node", "centre"), "minmax-members")
    # One row for each id and text, however often it is stored: two texts in many copies are one comparison.
    texts = docs.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    texts = stored(texts, "minmax-texts")

    pairs = members.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    shared_ids = stored(_shared(rows, nodes), "minmax-shared")
    first = shared_ids.groupBy("doc_id").agg(F.min("node").alias("a"))
    same = shared_ids.join(first, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    links = stored(confirmed(pairs, texts, size, percent).unionByName(same), "minmax-links")
    roots = stored(components(links), "minmax-roots")
    more = stored(_among(_apart(members.where("node <> centre"), roots), texts, size, percent), "minmax-links")
    if not more.isEmpty():
        roots = stored(components(links.unionByName(more)), "minmax-roots")

    named = nodes.join(roots, "node", "left").select("low", "high", "n_shingles", F.coalesce("root", "node").alias("root"))
    out = rows.drop("bands").join(named, ["low", "high", "n_shingles"], "left")
    # A row without words has the component of its id's other rows.
    other = stored(shared_ids.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("root")), "minmax-others")
    wordless = lookup_join(out.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles"), other, "doc_id", "left")
    worded = out.where("n_shingles > 0 or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))
    return worded.unionByName(wordless.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))


def op9_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every document, and whether it is the one that stays."""
    found = classes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id; of equal ids the first text.

    Texts without words come after all others. Rows of one id and text that differ elsewhere are ordered by
    their columns as JSON. Rows without an id all stay.
    """
    keys = classes(docs.select("doc_id", "text"), size, percent)
    ids = keys.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    ids = stored(ids.select("doc_id", F.expr("doc_id <> component_id").alias("gone"), "n").where("gone or n > 1"), "minmax-ids")
    once = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = lookup_join(docs, ids.where("not gone").select("doc_id"), "doc_id").select("doc_id", F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    order = F.struct(~text.rlike(WORD), text, F.to_json("row"))
    first = repeated.groupBy("doc_id").agg(F.min_by("row", order).alias("row")).select("row.*")
    return once.unionByName(first)
