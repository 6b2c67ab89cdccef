"""Ordered event sequences: anchored bursts, retry chains, forward fill, running offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRY_GAP, BURST_SPAN, BURST_FAMILIES = 300, 600, 4


def retry_chains(rows: DataFrame) -> DataFrame:
    """(sid, cmd, family, retries) of each failed command that was repeated within RETRY_GAP seconds, again and again.

    rows: sid, t, seq, cmd, family, err. Gaps and islands: per (sid, cmd) a new island begins after a longer
    pause; the chain begins at the island's first failure. Rows without t have no place in time and are left out.
    The windows are over (sid, cmd), so a large session is spread over its commands.
    """
    order = Window.partitionBy("sid", "cmd").orderBy("t", "seq")
    gap = F.col("t") - F.lag("t").over(order)
    marked = rows.where("t is not null").withColumn("island", F.sum(F.when(gap <= RETRY_GAP, 0).otherwise(1)).over(order))
    inside = Window.partitionBy("sid", "cmd", "island").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = marked.withColumn("after", F.sum(F.when(F.col("err"), 1).otherwise(0)).over(inside)).where("after > 0")
    chains = failed.groupBy("sid", "cmd", "island").agg((F.count("*") - 1).alias("retries"), F.min_by("family", F.struct("t", "seq")).alias("family"))
    return chains.where("retries > 0").select("sid", "cmd", "family", "retries")


BURSTS = "sid string, bin string, burst int, first_t bigint, rows bigint, secs double, families array<string>, sample string"


def _close(state: dict) -> tuple:
    return (state["sid"], state["bin"], state["burst"], state["first"], state["n"], state["secs"], sorted(state["families"], key=lambda f: (f is not None, f)), state["sample"])


def bursts(rows: DataFrame) -> DataFrame:
    """Bursts of commands of one program in one session: a row joins while it is within BURST_SPAN of the burst's first.

    rows: sid, bin, t, seq, family, cmd, secs. The anchor makes this a fold, not a gap window. Rows are hash partitioned
    by (sid, bin), sorted by spill-able Spark sort, and folded one by one with only the open burst in
    memory, so no group is ever collected. Families of a burst are bounded by the BURST_SPAN seconds it lasts.
    """
    cols = ["sid", "bin", "t", "seq", "family", "cmd", "secs"]
    ordered = rows.where("t is not null").select(*cols).repartition("sid", "bin").sortWithinPartitions("sid", "bin", "t", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            for sid, bin_, t, _, family, cmd, secs in zip(*[c.to_pylist() for c in batch.columns]):
                same = state is not None and (state["sid"], state["bin"]) == (sid, bin_)
                if not same or t - state["first"] > BURST_SPAN:
                    if state is not None:
                        out.append(_close(state))
                    state = {"sid": sid, "bin": bin_, "burst": state["burst"] + 1 if same else 0, "first": t, "n": 0, "secs": 0.0, "families": set(), "sample": cmd}
                state["n"] += 1
                state["secs"] += secs or 0.0
                state["families"].add(family)
                if cmd is not None and (state["sample"] is None or (len(cmd), cmd) < (len(state["sample"]), state["sample"])):
                    state["sample"] = cmd
            if len(out) > 5000:
                yield _bursts(out)
                out = []
        if state is not None:
            out.append(_close(state))
        if out:
            yield _bursts(out)

    return ordered.mapInArrow(run, BURSTS)


def _bursts(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.string())
    names = [c.split()[0] for c in BURSTS.replace("array<string>", "a").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def prefix_sums(df: DataFrame, by: list[str], order: list[str], columns: list[str], chunk: Column) -> DataFrame:
    """`df` with `before_<c>` for each column: the sum over all earlier rows of the group, in an order that `chunk` follows.

    Sums run inside chunks of a group, and what earlier chunks sum to is added: a group of any size is many tasks. Groups of a
    single chunk have no such offset, so the joined table holds the chunks of very large groups only.
    """
    df = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_chunk").agg(*[F.sum(c).alias(c) for c in columns])
    offsets = totals.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_chunk").alias("_c"), *[F.sum(c).over(earlier).alias(f"_off_{c}") for c in columns], F.row_number().over(Window.partitionBy(*by).orderBy("_chunk")).alias("_nth")).where("_nth > 1")
    same = F.col("_chunk") == F.col("_c")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    joined = rows.join(offsets, same, "left").withColumns({f"before_{c}": F.col(f"before_{c}") + F.coalesce(f"_off_{c}", F.lit(0)) for c in columns})
    return joined.drop("_chunk", "_c", "_nth", *[f"_{b}" for b in by], *[f"_off_{c}" for c in columns])


def forward_fill(value: Column, by: list[str], order: list[str]) -> Column:
    """The last non-null value up to here."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running_before(value: Column, by: list[str], order: list[str]) -> Column:
    """The sum of everything before this row."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
