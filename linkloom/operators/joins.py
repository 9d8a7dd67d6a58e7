"""Joins whose small side is measured before it is broadcast."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` with one distributed aggregate: total string bytes plus a row overhead."""
    width = F.lit(64)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + F.coalesce(F.octet_length(F.to_json(F.col(field.name))), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0]
    return (size or 0) <= limit


def lookup_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join that broadcasts ``small`` only when it measures under ``limit``.

    Beyond the limit both sides shuffle on the key and a salt, so that one key
    holding much of ``big`` is spread over ``SALTS`` tasks. The salt is a hash of
    the row: a task that is run again sends its rows to the same place.
    """
    if is_small(small, limit):
        return big.join(F.broadcast(small), on, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return left.join(small.withColumn("_salt", salts), [on, "_salt"], how).drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by ``key`` where fewer partitions are read than there are cores.

    A few files of a table would otherwise keep a few cores busy with what costs most, the scan of the bodies. What is
    moved is bounded by one partition for each core; larger inputs and streams are left as they lie.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
