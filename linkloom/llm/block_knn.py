"""Nearest neighbours by inner product: a block matrix join with int8 tiles and error bounds.

Rows and queries are packed into blocks. For a pair of blocks the int8 forms of both are multiplied as
matrices; with the norms of what quantisation left out, every product has a lower and an upper bound.
Rows whose upper bound lies under the k-th best lower bound cannot be among the best k and are gone; the
others are computed again from the original vectors, component by component in double precision, and
kept in a heap for each query. Blocks of one query block that meet in a task share its heaps; a ranking
window merges the heaps of all tasks.

* Null and zero vectors and those with null or non-finite components take no part, neither do null ids.
* Ties go to the smaller id. Rows that repeat an id are candidates each for itself, never for a query
  with that id; many equal vectors all pass the bounds and stay exact.
* Vectors of different widths are compared within their width. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.bitslice_topk import best_rows
from linkloom.llm.common import table
from linkloom.llm.vector_blocks import blocks, matrix, pairs, usable

ROWS_IN_BLOCK = 8192
QUERIES_IN_BLOCK = 1024
#: What rounding in double precision may add to a bound, relative to the product of the norms.
ROUNDING = 1e-12


class Tile:
    """The int8 form of a block: each row's scale, and the norms of the form and of what it leaves out."""

    def __init__(self, rows: np.ndarray):
        self.scale = np.abs(rows).max(axis=1)
        steps = np.divide(127.0, self.scale, out=np.zeros_like(self.scale), where=self.scale > 0)
        form = np.clip(np.rint(rows * steps[:, None]), -127, 127).astype(np.int8)
        back = form * (self.scale / 127)[:, None]
        self.norm, self.error = np.linalg.norm(back, axis=1), np.linalg.norm(rows - back, axis=1)
        #: Products of int8 values are summed without rounding in float32 while they stay under 2 ** 24.
        self.form = form.astype(np.float32 if rows.shape[1] <= 1024 else np.float64)


def survivors(queries: Tile, rows: Tile, same: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query, the places of rows that may be among its best k."""
    near = (queries.form @ rows.form.T).astype(np.float64)
    near *= (queries.scale / 127)[:, None] * (rows.scale / 127)[None, :]
    slack = queries.error[:, None] * (rows.norm + rows.error)[None, :] + queries.norm[:, None] * rows.error[None, :]
    slack += ROUNDING * (queries.norm + queries.error)[:, None] * (rows.norm + rows.error)[None, :]
    lower = np.where(same, -np.inf, near - slack)
    if lower.shape[1] > k:
        least = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
    else:
        least = np.full(len(lower), -np.inf)
    possible = (near + slack >= least[:, None]) & ~same
    return [np.flatnonzero(p) for p in possible]


def product(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += rows[:, d] * query[d]
    return total


class Heaps:
    """The best k of each query so far."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, query: tuple, ids: np.ndarray, scores: np.ndarray) -> None:
        heap = self.best.setdefault(query, [])
        order = np.lexsort((ids, -scores))[: self.k]
        for item in zip(scores[order].tolist(), (-ids[order]).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
            else:
                break

    def rows(self) -> pa.RecordBatch:
        found = [(q[0], -i, s) for q, heap in self.best.items() for s, i in heap]
        self.best = {}
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for usable vectors and queries; a query never finds its own id."""
    row_blocks = blocks(vectors, vectors.count(), ROWS_IN_BLOCK, "knn-rows")
    query_blocks = blocks(queries.distinct(), queries.count(), QUERIES_IN_BLOCK, "knn-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heaps = None, Heaps(k)
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_block"] != last:
                    if heaps.best:
                        yield heaps.rows()
                    last, q_ids, q = row["q_block"], np.frombuffer(row["q_ids"], np.int64), matrix(row["q_data"], row["width"])
                    q_tile = Tile(q)
                ids, x = np.frombuffer(row["ids"], np.int64), matrix(row["data"], row["width"])
                tile = Tile(x)
                for a in range(0, len(q), 128):  # so many rows of the product at a time
                    part = Tile.__new__(Tile)
                    part.__dict__ = {name: value[a : a + 128] for name, value in q_tile.__dict__.items()}
                    same = q_ids[a : a + 128, None] == ids[None, :]
                    for i, places in enumerate(survivors(part, tile, same, k), a):
                        heaps.add((int(q_ids[i]), i), ids[places], product(x[places], q[i]))
        if heaps.best:
            yield heaps.rows()

    met = pairs(row_blocks, query_blocks).where("width > 0")
    return best_rows(met.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def op8_block_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nearest rows for every twentieth vector."""
    some = F.exists("vector", lambda x: x != 0)
    vectors = usable(table(spark, folder, "embeddings").select("vec_id", "embedding"), some)
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.x, b.x) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
