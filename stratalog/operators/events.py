"""Wide events: one row a unit of work, sampling, lost runs, stitched hops, tag cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(key: Column, interesting: Column, rate: int) -> Column:
    """Tail sampling on the finished event: everything interesting, and one in `rate` of the rest, by a hash of its key."""
    return F.coalesce(interesting, F.lit(False)) | (F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(rate)) == 0)


def weight(interesting: Column, rate: int) -> Column:
    """How many events a kept one stands for."""
    return F.when(F.coalesce(interesting, F.lit(False)), 1).otherwise(rate)


def lost(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Units of work that began and never ended."""
    return starts.join(ends.select(key).distinct(), key, "left_anti")


def hops(events: DataFrame, correlation: str, at: str) -> DataFrame:
    """Events of one correlation as a chain: number of hops, first and last instant. Nulls belong to no chain."""
    return events.where(F.col(correlation).isNotNull()).groupBy(correlation).agg(F.count("*").alias("hops"), F.min(at).alias("first"), F.max(at).alias("last"))


def cardinality(events: DataFrame, tags: list[str], most: int = 20, product: int = 400) -> DataFrame:
    """One row a tag: distinct values, whether they are few enough, and whether all tags together are."""
    counts = events.agg(*[F.countDistinct(t).alias(t) for t in tags])
    rows = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("n")) for t in tags])
    all_ = F.aggregate(rows, F.lit(1).cast("double"), lambda a, r: a * r.n)
    return counts.select(F.explode(rows).alias("r"), (all_ <= product).alias("product_ok")).select("r.tag", "r.n", (F.col("r.n") <= most).alias("ok"), "product_ok")


def unused(loaded: DataFrame, invoked: DataFrame, on: list[str]) -> DataFrame:
    """What was loaded and never used."""
    return loaded.join(invoked.select(*on).distinct(), on, "left_anti")
