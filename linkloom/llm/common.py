"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import scratch_path

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one call keeps in the shared folder, and deletes once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stored``; several tables may have one name."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, or all."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def running_totals(steps: Column, block: int = 512) -> Column:
    """Inclusive running sums of an int array, in blocks, so that long arrays take no quadratic time."""

    def totals(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(
            values,
            start,
            lambda a, x: F.struct((a.total + x).alias("total"), F.array_append(a["all"], a.total + x).alias("all")),
            lambda a: a["all"],
        )

    def shifted(inner: Column) -> Column:
        ends = totals(F.transform(inner, lambda a: F.element_at(a, -1)))
        return let(
            F.concat(F.array(F.lit(0)), ends),
            lambda offsets: F.flatten(
                F.transform(inner, lambda a, i: F.transform(a, lambda x: x + F.get(offsets, i)))
            ),
        )

    def blocks(values: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
            lambda j: totals(F.slice(values, j * block + 1, F.lit(block))),
        )
        return let(cut, shifted)

    return let(steps, lambda s: F.when(F.size(s) > 0, blocks(s)).otherwise(F.array().cast("array<int>")))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and row offsets of string arrays; null rows are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        binary = chunk.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        _, offsets, data = binary.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def crc_remainder(doc_id: Column, by: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``size`` bytes of text at most, and one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving memory back to the system at its end: worker processes stay for the tasks and stages that follow."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped
