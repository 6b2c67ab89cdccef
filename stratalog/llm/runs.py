"""Runs of the same event, one row each.

Method: a lag window compares each event with the one before, changes are flagged, the flags' running sum is
the run's number, and runs are aggregated. A group may hold any share of all rows, so the windows
run inside range partitions of (group, time, id), cut by sampled quantiles; a run that a cut
goes through is stitched from its parts, of which a group has two a partition at most.

Events are compared by a digest of their key, and only group, time, id and digest are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm import commands
from stratalog.sources.tables import checkpointed


def collapse_events(events: DataFrame, group: str, time: str, order_id: str, key: str, least: int = 1) -> DataFrame:
    """Runs of at least `least` neighbours with the same `key`, per `group` in order of (time, order_id).

    Columns: g (the group), n, low and high (smallest and largest id), first (struct of t and id) and last_t. Rows with the same
    time and id are deliveries of one event and count once; rows without a time have no place in the order and are left out.
    A null key equals no other, so it is a run of its own; a null group is a group. An empty table gives no rows.
    Near-identical events are equal when `key` says so; it may be of any type that has a text.
    """
    digest = F.unhex(F.md5(F.col(key).cast("string").cast("binary")))
    slim = events.select(F.col(group).alias("g"), F.col(time).alias("t"), F.col(order_id).alias("id"), digest.alias("key")).where("t is not null")
    # Written once: the range partitioning samples its input, and would make the keys a second time.
    rows = checkpointed(slim).repartitionByRange("g", "t", "id").withColumn("part", F.spark_partition_id())  # right behind the range shuffle, so parts are ranges

    here = Window.partitionBy("part", "g").orderBy("t", "id")
    again = F.coalesce((F.lag("id").over(here) == F.col("id")) & (F.lag("t").over(here) == F.col("t")), F.lit(False))
    rows = rows.withColumn("again", again).where("not again")
    before = F.lag("key").over(here)
    rows = rows.withColumn("change", F.when(F.col("key") == before, 0).otherwise(1)).withColumn("run", F.sum("change").over(here))
    parts = rows.groupBy("part", "g", "run").agg(
        F.first("key").alias("key"), F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("last_t"),
    )
    # Runs are already clustered by (part, g); the last one's number needs no new shuffle.
    segment = Window.partitionBy("part", "g")
    parts = parts.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(segment)))
    parts = parts.where((F.col("n") >= least) | F.col("edge"))
    inner = F.when(~F.col("edge"), F.struct("part", "run"))
    order = Window.partitionBy("g", "inner").orderBy("first")
    joined = parts.withColumn("inner", inner).withColumn("go_on", F.coalesce((F.lag("key").over(order) == F.col("key")) & (F.lag("part").over(order) != F.col("part")), F.lit(False)))
    joined = joined.withColumn("chain", F.sum(F.when(F.col("go_on"), 0).otherwise(1)).over(order))
    runs = joined.groupBy("g", "inner", "chain").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last_t").alias("last_t"))
    return runs.where(F.col("n") >= least).select("g", "n", "low", "high", "first", "last_t")


def collapse(bash_rows: DataFrame, least: int = 1, texts: bool = True) -> DataFrame:
    """Runs of at least `least` neighbours with the same command, per session in order of (t, row_id).

    Columns: sid, n, low_row_id, high_row_id, first_t, last_t, span_sec and, with `texts`, cmd: that of the first event, looked up by its
    row_id, one of them where deliveries differ. Repeated deliveries (same row_id) count once; rows without t have no place in
    the order and are left out. A null command is a run of its own; an empty one equals other empty ones; a null sid is a
    session. An empty table gives no rows; columns besides sid, t, row_id and cmd are ignored.
    """
    keyed = bash_rows.where("t is not null").select("sid", "t", "row_id", F.pandas_udf(commands.keys, "string")("cmd").alias("key"))
    runs = collapse_events(keyed, "sid", "t", "row_id", "key", least)
    runs = runs.select(F.col("g").alias("sid"), "n", F.col("low").alias("low_row_id"), F.col("high").alias("high_row_id"), "first", F.col("first.t").alias("first_t"), "last_t", (F.col("last_t") - F.col("first.t")).alias("span_sec"))
    if texts:
        heads = bash_rows.select(F.struct("t", F.col("row_id").alias("id")).alias("first"), F.col("sid").alias("_sid"), "cmd").where("first.t is not null").groupBy("first", "_sid").agg(F.min("cmd").alias("cmd"))
        runs = runs.join(heads, runs["first"].eqNullSafe(heads["first"]) & runs["sid"].eqNullSafe(heads["_sid"]), "left").drop(heads["first"], heads["_sid"])
    return runs.drop("first")
