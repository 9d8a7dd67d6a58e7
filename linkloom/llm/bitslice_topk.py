"""Exact top-k by inner product over a bit-sliced index.

A block of rows is kept as bitmaps: one for each bit of each quantised component, over the rows. A
query's score is a weighted sum of components, so its slices come from bitmap arithmetic alone: every
set bit of a weight adds the component's slices at a shifted place, and carry-save adders sum the
bitmaps of each place three at a time. From the most significant slice of the sum downward, the rows that
must be among the best are selected and those that cannot be are dropped; the rows that tie at the
boundary are resolved by their id. Every block gives a query its best rows; a ranking window, which
Spark cuts before the shuffle, merges them.

* Vectors that are null or hold null or non-finite components take no part, neither do null ids.
* Ties go to the smaller id; rows that repeat an id are candidates each for itself, but never for a
  query with that id. A repeated query is answered once for each distinct vector.
* Vectors of different widths are compared within their width. An empty table gives an empty result.
* Scores are 64-bit integers. A vector whose scores could exceed them raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.vector_blocks import blocks, matrix, pairs, usable

SCALE = 256
ROWS_IN_BLOCK = 16384
QUERIES_IN_BLOCK = 512
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(values: np.ndarray) -> np.ndarray:
    """Integer components: floor of SCALE times the value."""
    scaled = np.floor(SCALE * values)
    if scaled.size and np.abs(scaled).max() * max(1, values.shape[1]) ** 0.5 > 2.0**31:
        raise ValueError("components are too large for 64-bit scores")
    return scaled.astype(np.int64)


def _bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the first row's bit lowest."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    pad = -raw.shape[-1] % 8
    return np.ascontiguousarray(np.pad(raw, [(0, 0)] * (raw.ndim - 1) + [(0, pad)])).view(np.uint64)


class SlicedIndex:
    """Bitmaps of one block: for each component, the slices of its distance from the least and from the largest value."""

    def __init__(self, rows: np.ndarray):
        self.count = len(rows)
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.bits = max(1, int((self.high - self.low).max()).bit_length())
        places = np.arange(self.bits)[None, :, None]
        up = _bitmaps(((rows - self.low).T[:, None, :] >> places) & 1 == 1)
        down = _bitmaps(((self.high - rows).T[:, None, :] >> places) & 1 == 1)
        self.slices = np.stack([up, down])  # sign, component, bit, word
        self.all = _bitmaps(np.ones((1, self.count), bool))[0]

    def scores(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the weighted sum, least significant first, and what is to be added to it.

        A negative weight counts the distance from the largest value instead, so that all terms are added.
        """
        base = int(np.where(weights >= 0, self.low, self.high) @ weights)
        size, sign = np.abs(weights), (weights < 0).astype(int)
        width = int(size.max()).bit_length() if size.size else 0
        set_bits = [np.flatnonzero((size >> a) & 1) for a in range(width)]
        words = self.slices.shape[-1]
        out, carried, place = [], np.zeros((0, words), np.uint64), 0
        while place < width + self.bits or len(carried):
            terms = [carried]
            for a in range(max(0, place - self.bits + 1), min(width, place + 1)):
                if len(set_bits[a]):
                    terms.append(self.slices[sign[set_bits[a]], set_bits[a], place - a])
            column, carries = np.concatenate(terms), []
            while len(column) >= 3:
                n = len(column) // 3
                x, y, z = column[:n], column[n : 2 * n], column[2 * n : 3 * n]
                half = x ^ y
                carries.append((x & y) | (z & half))
                column = np.concatenate([half ^ z, column[3 * n :]])
            if len(column) == 2:
                carries.append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0] if len(column) else np.zeros(words, np.uint64))
            carried = np.concatenate(carries) if carries else np.zeros((0, words), np.uint64)
            place += 1
        return out, base

    def top(self, weights: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows but those in ``without``; among equals the first places."""
        slices, base = self.scores(weights)
        undecided = self.all.copy()
        for i in without:
            undecided[i >> 6] &= FULL ^ (np.uint64(1) << np.uint64(i & 63))
        sure, held = np.zeros_like(undecided), 0
        for bitmap in reversed(slices):
            higher = undecided & bitmap
            n = int(np.bitwise_count(higher).sum())
            if held + n > k:
                undecided = higher
            else:
                sure, held = sure | higher, held + n
                undecided = undecided & ~bitmap
                if held == k:
                    break
        best = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        tied = np.flatnonzero(np.unpackbits(undecided.view(np.uint8), bitorder="little"))[: k - held] if held < k else best[:0]
        places = np.concatenate([best, tied])
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        scores = np.full(len(places), base, np.int64)
        for a, bitmap in enumerate(slices):
            scores += (((bitmap[word] >> bit) & np.uint64(1)).astype(np.int64)) << a
        return places, scores


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for usable vectors and queries; a query never finds its own id."""
    row_blocks = blocks(vectors, vectors.count(), ROWS_IN_BLOCK, "bsi-rows")
    query_blocks = blocks(queries.distinct(), queries.count(), QUERIES_IN_BLOCK, "bsi-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, ids = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last:
                    last, ids = row["block"], np.frombuffer(row["ids"], np.int64)
                    index = SlicedIndex(quantised(matrix(row["data"], row["width"])))
                q_ids, out = np.frombuffer(row["q_ids"], np.int64), []
                for q, weights in zip(q_ids, quantised(matrix(row["q_data"], row["width"])), strict=True):
                    own = np.arange(np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right"))
                    places, scores = index.top(weights, k, own)
                    out.append((np.full(len(places), q), ids[places], scores))
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    met = pairs(row_blocks, query_blocks).where("width > 0")
    return best_rows(met.mapInArrow(run, "query_id long, vec_id long, score long"), k)


def op2_bitslice_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows for every fiftieth vector, by quantised inner product."""
    vectors = usable(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
