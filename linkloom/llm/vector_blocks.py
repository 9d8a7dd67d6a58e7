"""Vectors in blocks of bounded size, and every query block beside every row block.

Searches that compare a stated set of queries with all rows use this: rows and queries are packed into
blocks, one table row each, and both sides are copied so often that each pair of blocks meets once, on
a key of its own. No task gets more than pairs of two bounded blocks, whatever the vectors hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored

BLOCK = "ids binary, data binary, width int"


def usable(vectors: DataFrame, also: Column | None = None) -> DataFrame:
    """``vec_id, vector`` in double precision, without null vectors, null or non-finite components, and null ids."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    kept = rows.where("vec_id is not null and vector is not null").where(finite)
    return kept.where(also) if also is not None else kept


def blocks(vectors: DataFrame, rows: int, rows_in_block: int, name: str) -> DataFrame:
    """Pack vectors into stored blocks ``ids, data, width, block``: rows by id, of one width in each block."""
    parts = max(1, -(-rows // rows_in_block))

    def flush(ids: list[int], data: list[np.ndarray], width: int) -> pa.RecordBatch:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        matrix = np.array(data, np.float64).reshape(len(ids), width)[order]
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([width], pa.int32())],
            ["ids", "data", "width"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = {}, {}
        for batch in batches:
            vector = batch.column("vector")
            bounds, flat = vector.offsets.to_numpy(), vector.values.to_numpy(zero_copy_only=False)
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                x = flat[bounds[i] : bounds[i + 1]].copy()
                ids.setdefault(len(x), []).append(vec_id)
                data.setdefault(len(x), []).append(x)
                if len(ids[len(x)]) >= rows_in_block:
                    yield flush(ids.pop(len(x)), data.pop(len(x)), len(x))
        for width in sorted(ids):
            yield flush(ids[width], data[width], width)

    packed = vectors.select("vec_id", "vector").repartition(parts).mapInArrow(run, BLOCK)
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), name)


def pairs(row_blocks: DataFrame, query_blocks: DataFrame) -> DataFrame:
    """Each query block beside each row block of its width, once: ``q_ids, q_data, ids, data, width, q_block, block``.

    Only block numbers are listed on the driver side of the plan, as arrays in one row for each width.
    """
    numbers = lambda blocks, to: blocks.groupBy("width").agg(F.collect_list("block").alias(to))
    queries = query_blocks.select("width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("block").alias("q_block"))
    left = queries.join(numbers(row_blocks, "others"), "width").withColumn("block", F.explode("others")).drop("others", "width")
    right = row_blocks.join(numbers(query_blocks, "others"), "width").withColumn("q_block", F.explode("others")).drop("others")
    return left.join(right, ["q_block", "block"])


def matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width) if width else np.zeros((0, 0))
