"""Streams over files against their batch twins."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stratalog.operators import sequences as S
from stratalog.plans import streams
from stratalog.streaming import streams as Z

SCHEMA = "row_id bigint, sid string, bin string, t bigint, family string, cmd string, err boolean, tool string, durSec double"
BASE = 1_200_000  # instant zero is the first watermark, so rows there would be late
FAR = 10**7  # a row far ahead moves the watermark past everything before


def source(spark, tmp_path, rows):
    for i, part in enumerate((rows, [(-1, "end", "end", FAR, "f", "end", False, "end", 1.0)], [(-2, "end", "end", FAR + 10, "f", "end", False, "end", 1.0)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    return Z.timed(Z.rows(spark, str(tmp_path / "t.parquet"), 1), "10 seconds")


ROWS = [(i, "s", "git", BASE + t, f"f{i}", "c", i == 0, "Bash", 1.5) for i, t in enumerate([0, 300, 600, 601, 700, 900, 1000, 1201, 1202])] + [(99, "s", "git", None, "f", "c", True, "Bash", 1.0), (3, "s", "git", BASE + 601, "f3", "c", False, "Bash", 1.5)]


def test_retry_chains(spark, tmp_path):
    got = [(r.sid, r.cmd, r.retries) for r in Z.drain(Z.retry_chains(source(spark, tmp_path, ROWS))).where("sid = 's'").collect()]
    batch = S.retry_chains(spark.createDataFrame(ROWS, SCHEMA).dropDuplicates(["row_id"]).withColumn("seq", F.col("row_id"))).collect()
    assert got == [(r.sid, r.cmd, r.retries) for r in batch] == [("s", "c", 8)]


def test_bursts(spark, tmp_path):
    got = sorted((r.first_t, r.n, r.families) for r in Z.drain(Z.bursts(source(spark, tmp_path, ROWS))).where("sid = 's'").collect())
    batch = S.bursts(spark.createDataFrame(ROWS, SCHEMA).dropDuplicates(["row_id"]).withColumns({"seq": F.col("row_id"), "secs": F.lit(1.0)})).where("size(families) >= 4").collect()
    assert got == sorted((r.first_t, r.rows, len(r.families)) for r in batch) == [(BASE + 601, 5, 5)]


def test_windows(spark, tmp_path):
    got = Z.drain(Z.wall_by_window(source(spark, tmp_path, ROWS))).where("tool = 'Bash'").orderBy("start").collect()
    assert [(r.calls, r.ms, r.errors) for r in got] == [(2, 3000, 1), (5, 7500, 0), (2, 3000, 0)]


def test_lost_and_joined(spark, tmp_path):
    times = "sid string, id string, t bigint"
    for name, rows in (("a", [("s", "1", BASE), ("s", "2", BASE), ("e", "x", FAR), ("e", "z", FAR + 9)]), ("b", [("s", "1", BASE + 60), ("e", "y", FAR), ("e", "w", FAR + 9)])):
        for r in rows:
            spark.createDataFrame([r], times).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}.parquet"))
    side = lambda n: Z.rows(spark, str(tmp_path / f"{n}.parquet"), 1).withColumn("ts", F.timestamp_seconds("t"))
    joined = Z.drain(Z.join_results(side("a"), side("b"))).where("sid = 's'")
    assert {(r.id, r.answered is not None) for r in joined.collect()} == {("1", True), ("2", False)}


def test_many_files_out_of_order(spark, tmp_path):
    folder = tmp_path / "tool_rows.parquet"
    folder.mkdir()
    day = 86_400
    rows = [(i, "s", "git", BASE + (40 * day if i < 66 else 0) + i, "f", "c", False, "Bash", 1.0) for i in range(70)] + [(70, "s", "git", BASE + 200 * day, "f", "c", False, "Bash", 1.0)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for k, r in enumerate(rows[66:70] if k == 65 else [rows[70 if k == 0 else k]] for k in range(66)):
        pq.write_table(pa.Table.from_pylist([dict(zip(names, x)) for x in r]), folder / f"p{k:02}.parquet")
        os.utime(folder / f"p{k:02}.parquet", (10**9 + k, 10**9 + k))
    got = streams.stream_wall_tumbling(spark, str(tmp_path))
    assert got.agg(F.sum("calls")).first()[0] == 68  # 64 rows of the 65 files in front are over 30 days before the last, and 4 long before those


def test_retry_chains_are_keyed_by_session(spark, tmp_path):
    day = 86_400
    rows = [(i, f"s{i % 3}", "git", BASE + (i // 3) * 90 + (2 * day if i > 150 else 0), "f", f"c{(i * i) % 11}", i % 4 == 0, "Bash", 1.0) for i in range(300)]
    stream = Z.retry_chains(source(spark, tmp_path, rows))
    got = sorted((r.sid, r.cmd, r.retries) for r in Z.drain(stream).where("sid <> 'end'").collect())
    batch = S.retry_chains(spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.col("row_id"))).collect()
    assert got == sorted((r.sid, r.cmd, r.retries) for r in batch) and len(got) >= 20
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "share#" in plan
