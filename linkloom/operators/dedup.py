"""First-wins de-duplication and the set operations built on it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# The order that decides which of several equal findings is kept.
ARRIVAL = ["depth", "phase", "page_id", "ord"]


def first_seen(df: DataFrame, keys: list[str], order: list[str] = ARRIVAL) -> DataFrame:
    """Keep the earliest row of each key.

    A minimum over ``struct(order, rest)`` combines on the map side, so a key held
    by a third of all rows costs one row per task in the shuffle; a window would
    send every copy to one task and sort it there.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def exact_unique(df: DataFrame, *columns: str) -> DataFrame:
    """Case-sensitive distinct rows."""
    return df.select(*columns).distinct()


def unseen(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key has not been seen before."""
    return candidates.join(seen.select(*keys).distinct(), keys, "left_anti")


def canonical_groups(pages: DataFrame) -> DataFrame:
    """Pages per canonical URL, ignoring case: the first page and how many there are."""
    keyed = urls.with_canonical(pages.select("page_id", "url"), "url").where("canonical is not null")
    return keyed.groupBy(F.lower("canonical").alias("key")).agg(
        F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("copies")
    )


def seen_key(value: Column) -> Column:
    """Key under which a value is remembered."""
    return F.lower(value)
