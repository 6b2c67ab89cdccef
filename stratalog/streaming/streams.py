"""Structured Streaming twins of the sequence operators.

Each takes streaming (or batch) DataFrames and returns one; `drain` runs a stream over all that is there and
gives the result back as a table. Event time comes from epoch seconds; watermarks say how late rows may be.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalog.operators.sequences import BURST_FAMILIES, BURST_SPAN, RETRY_GAP
from stratalog.sources.tables import shared_folder

LATE = "30 days"


def rows(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files; the schema is read once from the table.

    A stored table isn't ordered by time, so all its files come in one trigger: the watermark moves only after it, and no row is late. With
    `per_trigger`, for files that arrive in order, rows of later triggers may be.

    A file stream wants a folder or a pattern, so a table that is a single file is named by a pattern that only it fits.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", per_trigger) if per_trigger else stream).parquet(f"{path[:-1]}[{path[-1]}]")


def timed(df: DataFrame, late: str = LATE, key: str = "row_id") -> DataFrame:
    """Rows with a time as `ts`, each once within the watermark; rows without t have no event time and are left out."""
    return df.where("t is not null").withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tail_files(spark: SparkSession, root: str) -> DataFrame:
    """New transcript lines as files arrive: file, proj, raw."""
    meta = F.col("_metadata")
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    return lines.select(meta["file_path"].alias("file"), meta["file_modification_time"].alias("mtime"), F.col("value").alias("raw")).where("not endswith(file, '/journal.jsonl')")


def wall_by_window(tools: DataFrame, size: str = "10 minutes") -> DataFrame:
    """Calls, errors and milliseconds of each tool in tumbling windows; a window comes out once the watermark passes it."""
    g = tools.groupBy(F.window("ts", size).alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum(F.coalesce(F.round(F.col("durSec") * 1000), F.lit(0)).cast("bigint")).alias("ms"), F.sum(F.coalesce(F.col("err").cast("int"), F.lit(0))).alias("errors"))
    return g.select(F.col("w.start").alias("start"), "tool", "calls", "ms", "errors")


def gap_sessions(rows_: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of activity of a session with pauses no longer than the gap."""
    g = rows_.groupBy(F.session_window("ts", gap).alias("w"), "sid").agg(F.count("*").alias("n"))
    return g.select("sid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def join_results(calls: DataFrame, results: DataFrame, within: str = "1 hour") -> DataFrame:
    """Calls with their results (both: sid, id, ts); a call without one in time comes out with nulls once the watermark says so."""
    c = calls.select(F.col("sid").alias("sid"), "id", F.col("ts").alias("called")).withWatermark("called", LATE)
    r = results.select(F.col("sid").alias("r_sid"), F.col("id").alias("r_id"), F.col("ts").alias("answered")).withWatermark("answered", LATE)
    on = (F.col("sid") == F.col("r_sid")) & (F.col("id") == F.col("r_id")) & (F.col("answered") >= F.col("called")) & (F.col("answered") <= F.col("called") + F.expr(f"interval {within}"))
    return c.join(r, on, "left_outer").select("sid", "id", "called", "answered")


def lost_runs(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Starts that no end followed in time."""
    return join_results(starts, ends, within).where("answered is null").select("sid", "id", "called")


BURSTS = "sid string, bin string, first_t bigint, n bigint, families int"


def _bursts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open burst is the state: (first t, rows, families so far). A timeout closes it."""
    first, n, families = state.get if state.exists else (None, 0, [])
    seen, out = set(families), []
    if state.hasTimedOut:
        out.append((*key, first, n, len(seen)))
        state.remove()
    else:
        frame = pd.concat(frames).sort_values("t", kind="stable")
        for t, family in zip(frame["t"].tolist(), frame["family"].fillna("").tolist()):
            if first is None or t - first > BURST_SPAN:
                if first is not None:
                    out.append((*key, first, n, len(seen)))
                first, n, seen = t, 0, set()
            n += 1
            seen.add(family)
        state.update((first, n, sorted(seen)))
        state.setTimeoutTimestamp(max((first + BURST_SPAN + 1) * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([r for r in out if r[4] >= BURST_FAMILIES], columns=["sid", "bin", "first_t", "n", "families"])


def bursts(bash: DataFrame) -> DataFrame:
    """Anchored bursts of one program in a session, as they close; rows later than the watermark are left out."""
    keyed = bash.select("sid", "bin", "t", "family", "ts").groupBy("sid", "bin")
    return keyed.applyInPandasWithState(_bursts, BURSTS, "first bigint, n bigint, families array<string>", "append", GroupStateTimeout.EventTimeTimeout)


CHAINS = "sid string, cmd string, retries bigint"
#: A session's commands are dealt to so many keys.
SPREAD = 2


def _chains(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the open chains of a session's commands: (command, last t, rows since its first failure). A command that hasn't failed has none."""
    chains = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
    out, fed, now = [], set(), state.getCurrentWatermarkMs()
    if not state.hasTimedOut:
        rows = [r for f in frames for r in zip(f["t"].tolist(), f["cmd"].tolist(), f["err"].tolist())]
        for t, cmd, err in sorted(rows, key=lambda r: r[0]):
            last, run = chains.get(cmd, (t, 0))
            if t - last > RETRY_GAP:
                out.append((key[0], cmd, run - 1))
                run = 0
            if run or err:
                chains[cmd] = (t, run + 1)
                fed.add(cmd)
            else:
                chains.pop(cmd, None)
    for cmd in [c for c, (last, _) in chains.items() if c not in fed and (last + RETRY_GAP + 1) * 1000 <= now]:
        out.append((key[0], cmd, chains.pop(cmd)[1] - 1))
    if chains:
        state.update((list(chains), [last for last, _ in chains.values()], [run for _, run in chains.values()]))
        state.setTimeoutTimestamp(max((min(last for last, _ in chains.values()) + RETRY_GAP + 1) * 1000, now + 1))
    elif state.exists:
        state.remove()
    if ended := [r for r in out if r[2] > 0]:
        yield pd.DataFrame(ended, columns=["sid", "cmd", "retries"])


def retry_chains(bash: DataFrame) -> DataFrame:
    """Failed commands and how often they were run again, as chains end. A key is a share of a session, not a command: most commands are run once, and each key is a call of Python."""
    cmd = F.trim(F.regexp_replace("cmd", r"\s+", " "))
    rows = bash.where("cmd is not null").select("sid", cmd.alias("cmd"), "t", F.coalesce("err", F.lit(False)).alias("err"), "ts", F.pmod(F.xxhash64(cmd), F.lit(SPREAD)).alias("share"))
    return rows.groupBy("sid", "share").applyInPandasWithState(_chains, CHAINS, "cmds array<string>, lasts array<bigint>, runs array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame) -> DataFrame:
    """Runs a stream over everything available and reads its result back; state and output lie in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
