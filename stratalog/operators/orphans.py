"""References to records that don't exist, per table and month.

Method: every key, referring or referred to, gets an integer from a distributed dictionary. Per key range
(32,768 consecutive integers), source and month the referring integers become one bitmap; per key range the
existing ones become another. Reference AND-NOT parent leaves the orphans' bits, which are decoded back.
Bitmaps travel deflated, so sparse ranges cost a few bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators import lines as L
from stratalog.sources.tables import checkpointed

SHIFT, BITS = 15, 32768  # of one bitmap of bitmap_construct_agg


def month(ts: str | Column = "ingested_at") -> Column:
    """The period of a reference: the month it was delivered, yyyy-MM."""
    return F.date_format(ts, "yyyy-MM")


def _use_and_result(rows: Iterator[tuple]) -> Iterator[tuple]:
    for sid, period, raw in rows:
        line = L.parse(raw)
        if line is None:
            continue
        for _, _, kind, block in L.blocks(L.message(line).get("content")):
            name = {"tool_use": "id", "tool_result": "tool_use_id"}.get(kind)
            if name and isinstance(block, dict) and isinstance(block.get(name), str):
                yield sid, block[name], kind == "tool_use", period


def call_references(transcript_lines: DataFrame) -> DataFrame:
    """(ns, scope, key, src, period): what tool_result blocks refer to, and with null src what tool_use blocks provide."""
    src = transcript_lines.where("sid is not null").withColumn("_m", month())
    found = L.visit(src, ["sid", "_m", "raw"], "scope string, key string, provides boolean, period string", _use_and_result)
    return found.select(F.lit("call").alias("ns"), "scope", "key", F.when(~F.col("provides"), F.lit("tool_result")).alias("src"), F.when(~F.col("provides"), F.col("period")).alias("period"))


def references(df: DataFrame, column: str, src: str) -> DataFrame:
    """Session references of one table; null ones refer to nothing."""
    return df.where(df[column].isNotNull()).select(F.lit("sid").alias("ns"), F.lit("").alias("scope"), df[column].alias("key"), F.lit(src).alias("src"), month().alias("period"))


def parents(df: DataFrame, column: str) -> DataFrame:
    """The keys a parent table provides."""
    return df.where(df[column].isNotNull()).select(F.lit("sid").alias("ns"), F.lit("").alias("scope"), df[column].alias("key"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("period"))


def dictionary(keys: DataFrame) -> DataFrame:
    """Each distinct key with its integer `id`, and the (src, period) pairs that refer to it.

    One hash shuffle with map-side combining: a key named by a third of all rows arrives as one partial
    per map task. The set is bounded by sources x months. Ids are dense inside each partition and stable,
    since the dictionary is written to the shared checkpoint folder.
    """
    grouped = keys.groupBy("ns", "scope", "key").agg(F.max(F.col("src").isNull()).alias("provided"), F.collect_set(F.when(F.col("src").isNotNull(), F.struct("src", "period"))).alias("uses"))
    return checkpointed(grouped.withColumn("id", F.monotonically_increasing_id()))


def deflate(bits: pd.Series) -> pd.Series:
    return bits.map(lambda b: zlib.compress(b, 1))


def and_not(refs: pd.Series, have: pd.Series) -> pd.Series:
    """Positions of the bits in `refs` that `have` lacks; a missing parent bitmap is an empty one."""

    def one(r: bytes, h: bytes | None) -> np.ndarray:
        a = np.frombuffer(zlib.decompress(r), np.uint8)
        if h is not None:
            a = a & ~np.frombuffer(zlib.decompress(h), np.uint8)
        return np.flatnonzero(np.unpackbits(a, bitorder="little")).astype(np.int32)

    return pd.Series([one(r, h) for r, h in zip(refs, have)])


def orphans(coded: DataFrame) -> DataFrame:
    """Orphan references of a dictionary: ns, scope, key, src, period."""
    packed, minus = F.pandas_udf(deflate, "binary"), F.pandas_udf(and_not, "array<int>")
    bucket, bit = F.shiftright("id", SHIFT), F.col("id") % BITS
    placed = coded.select(bucket.alias("bucket"), bit.alias("bit"), "provided", "uses")
    used = placed.select("bucket", "bit", F.explode("uses").alias("u")).groupBy("bucket", "u.src", "u.period").agg(packed(F.bitmap_construct_agg("bit")).alias("refs"))
    have = placed.where("provided").groupBy("bucket").agg(packed(F.bitmap_construct_agg("bit")).alias("have"))
    left = used.join(have, "bucket", "left").select("src", "period", "bucket", F.explode(minus("refs", "have")).alias("bit"))
    left = left.select("src", "period", (F.shiftleft("bucket", SHIFT) + F.col("bit")).alias("id"))
    return left.join(coded.select("id", "ns", "scope", "key"), "id").select("ns", "scope", "key", "src", "period")


def find_orphans(transcript_lines: DataFrame, session_rows: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Orphans of all three kinds: src, sid, ref, period; one row per month in which the reference came.

    facts: source name -> table with `sid` and `ingested_at`. Nulls refer to nothing; empty strings are keys
    like others; empty tables give no rows (an empty session table makes every reference an orphan).
    """
    keys = call_references(transcript_lines).unionByName(parents(session_rows, "sid")).unionByName(references(session_rows, "parent", "session_rows"))
    for name, df in {**facts, "transcript_lines": transcript_lines}.items():
        keys = keys.unionByName(references(df, "sid", name))
    found = checkpointed(orphans(dictionary(keys)))
    own = F.when(F.col("ns") == "call", F.col("scope")).otherwise(F.col("key"))
    plain = found.where("src <> 'session_rows'").select("src", own.alias("sid"), F.col("key").alias("ref"), "period")
    children = session_rows.where("parent is not null and sid is not null").select("sid", F.col("parent").alias("ref"), month().alias("period")).distinct()
    lost = found.where("src = 'session_rows'").select("src", F.col("key").alias("ref"), "period").join(children, ["ref", "period"])
    return plain.unionByName(lost.select("src", "sid", "ref", "period"))
