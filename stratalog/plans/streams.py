"""Streaming twins, run over all files of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans.catalogue import Catalogue
from stratalog.streaming import streams as Z

query = Catalogue()


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return Z.timed(Z.rows(spark, f"{sf}/{name}.parquet"))


@query()
def stream_wall_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return Z.drain(Z.wall_by_window(_stream(spark, sf, "tool_rows")))


@query()
def stream_gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return Z.drain(Z.gap_sessions(_stream(spark, sf, "bash_rows")))


@query()
def stream_bursts(spark: SparkSession, sf: str) -> DataFrame:
    return Z.drain(Z.bursts(_stream(spark, sf, "bash_rows")))


@query()
def stream_retry_chains(spark: SparkSession, sf: str) -> DataFrame:
    return Z.drain(Z.retry_chains(_stream(spark, sf, "bash_rows")))


def _calls_and_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Shell calls as starts, and the tool rows of the same id as what answers them."""
    def side(name: str) -> DataFrame:
        df = Z.rows(spark, f"{sf}/{name}.parquet").where("t is not null")
        return df.select("sid", F.col("row_id").cast("string").alias("id"), F.timestamp_seconds("t").alias("ts"))

    return side("bash_rows"), side("tool_rows")


@query()
def stream_call_result_join(spark: SparkSession, sf: str) -> DataFrame:
    return Z.drain(Z.join_results(*_calls_and_results(spark, sf))).distinct()


@query()
def stream_lost_runs(spark: SparkSession, sf: str) -> DataFrame:
    return Z.drain(Z.lost_runs(*_calls_and_results(spark, sf))).distinct()


QUERIES, ORACLES = query.queries, query.oracles
