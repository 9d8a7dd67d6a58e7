"""Mixing sources to target weights with pivotal dependent rounding.

Every source gets a target in words: a share of the budget by its weight, at most ``cap`` times its
size, the excess shared again by weight. A document is then taken a whole number of times. What is
fractional is rounded by pairs: the words that two documents have above their whole copies are moved
from one to the other, up or down at random so that expectations stay, until one of the two holds
none or one whole copy. The pairs of a source keep its sum of words, so only the very last document
of a source changes it, by half its size at most.

Pairs form inside buckets of bounded size; the one document that stays open in each bucket goes to
the next round, where 32 buckets meet. A source that holds a third of all rows has many buckets.

* Null and empty texts, and texts of white space alone, have size 0 and nothing is taken from them.
* Null sources are one source, the last one. Repeated rows are documents of their own.
* An empty table gives an empty result; columns of other names are never looked at.
* Reruns agree: buckets and random numbers depend on the rows' values and the seed alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import WORD, stored, table
from linkloom.operators.joins import lookup_join
from linkloom.session import materialized

#: Documents that one bucket holds on average, and buckets that meet in the next round.
BUCKET_ROWS = 8192
FAN_IN = 32
SHARE = "doc_id long, size long, key string, source_size long, target double, bucket long, buckets long, whole long, mass double"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, key, size``: the source as a key that tells null from every name, and the number of words."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("key"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``key, source_size, documents, target``: one row per source.

    Keys sort as the sources' code points, null last; weights repeat in that order. The level of the
    shares is found by raising it while sources reach their cap, one aggregate over the sources each time.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked = sums.orderBy("key").rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    ranks = spark.createDataFrame(ranked, "key string, source_size long, documents long, place long")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialized(ranks.select("key", "source_size", "documents", weight.alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * cap
    level = 0.0
    while True:
        capped = most <= F.col("weight") * level
        full, open_weight = sources.agg(F.sum(F.when(capped, most).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or (risen := (budget * total - full) / open_weight) <= level:
            break
        level = risen
    return sources.select("key", "source_size", "documents", F.least(most, F.col("weight") * level).alias("target"))


def _settled(rows: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Round the open masses of one bucket until at most one is left; the last bucket of a source leaves none."""
    rows = rows.sort_values(["size", "doc_id", "mass"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    first = rows.iloc[0]
    key = f"{seed}:{level}:{first['key']}:{first['bucket']}"
    rng = np.random.default_rng(zlib.crc32(key.encode()))
    size, mass = rows["size"].to_numpy(np.float64), rows["mass"].to_numpy(np.float64, copy=True)
    draws = rng.random(len(rows))
    held = -1
    for i in range(len(rows)):
        if not 0 < mass[i] < size[i]:
            continue
        if held < 0:
            held = i
            continue
        up, down = min(size[held] - mass[held], mass[i]), min(mass[held], size[i] - mass[i])
        if draws[i] * (up + down) < down:
            a, b = (size[held], mass[i] - up) if size[held] - mass[held] <= mass[i] else (mass[held] + up, 0.0)
        else:
            a, b = (0.0, mass[i] + down) if mass[held] <= size[i] - mass[i] else (mass[held] - down, size[i])
        mass[held], mass[i] = a, b
        held = held if 0 < a < size[held] else i if 0 < b < size[i] else -1
    if held >= 0 and first["buckets"] == 1:
        mass[held] = size[held] if 2 * mass[held] >= size[held] else 0.0
    return rows.assign(mass=mass)


def _round(seed: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _settled(rows, seed, level)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` for every row of ``docs``."""
    sizes = stored(sized(docs), "mix-sizes")
    goals = targets(sizes, weights, budget, cap)
    buckets = F.ceil(F.col("documents") / BUCKET_ROWS)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = lookup_join(sizes, goals, "key").select(
        "doc_id", "size", "key", "source_size", "target",
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), buckets).alias("bucket"),
        buckets.alias("buckets"),
        F.floor(ratio).alias("whole"),
        ((ratio - F.floor(ratio)) * F.col("size")).alias("mass"),
    )
    most = goals.agg(F.max(buckets)).first()[0] or 0
    is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    done, level, current = [], 0, shares
    while True:
        current = current.groupBy("key", "bucket").applyInPandas(_round(seed, level), SHARE)
        if most <= 1:
            done.append(current)
            break
        current = stored(current, f"mix-round-{level}")
        done.append(current.where(~is_open))
        current = current.where(is_open).withColumns(
            {"bucket": F.floor(F.col("bucket") / FAN_IN), "buckets": F.ceil(F.col("buckets") / FAN_IN)}
        )
        most, level = -(-most // FAN_IN), level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    extra = F.when((F.col("size") > 0) & (F.col("mass") >= F.col("size")), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken.

    Rows that share an id are matched with their copies in order of size.
    """
    order = Window.partitionBy("mix_id").orderBy("mix_size", "mix_row")
    copies = mixed(docs, **options).select(F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), "copies")
    numbered = copies.withColumn("mix_row", F.lit(0)).withColumn("mix_place", F.row_number().over(order)).drop("mix_row", "mix_size")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    whole = docs.select(F.struct(*docs.columns).alias("mix_doc"), F.col("doc_id").cast("long").alias("mix_id"), size.alias("mix_size"), F.xxhash64("text").alias("mix_row"))
    rows = whole.withColumn("mix_place", F.row_number().over(order))
    joined = rows.join(numbered, rows.mix_id.eqNullSafe(numbered.mix_id) & (rows.mix_place == numbered.mix_place))
    return joined.where("copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("mix_doc.*")


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
