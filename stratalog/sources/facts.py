"""The fact tables with each row once, however often it was delivered."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import text as T
from stratalog.sources.tables import table


def distinct_rows(df: DataFrame, key: str = "row_id") -> DataFrame:
    """One row a key. Deliveries of a row are alike but for `ingested_at`, which is left out."""
    return df.drop("ingested_at").dropDuplicates([key])


def tools(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_rows(all_tools(table(spark, sf, "tool_rows"), table(spark, sf, "bash_rows")))


def all_tools(tool_rows: DataFrame, bash_rows: DataFrame) -> DataFrame:
    """Tool rows, and the shell calls as such where tool rows have none at all, so that no call counts twice."""
    if not tool_rows.where("tool = 'Bash'").isEmpty():
        return tool_rows
    return tool_rows.unionByName(bash_rows.withColumns({"tool": F.lit("Bash"), "arg": T.clip(F.col("cmd"), 200)}).select(*tool_rows.columns))


def errors(spark: SparkSession, sf: str) -> DataFrame | None:
    """Failed calls of all tools, None where the tables have no such one."""
    try:
        return distinct_rows(table(spark, sf, "error_rows"))
    except AnalysisException:
        return None


def bash(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_rows(table(spark, sf, "bash_rows"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_rows(table(spark, sf, "user_msg_rows"))


def sessions(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The latest snapshot of each session; with `columns`, those alone are read (a struct's fields aren't pruned through an aggregate)."""
    df = table(spark, sf, "session_rows")
    wanted = list(columns) or [c for c in df.columns if c != "sid"]
    return df.groupBy("sid").agg(F.max_by(F.struct(*wanted), "ingested_at").alias("r")).select("sid", "r.*")


def msecs(c: str = "durSec"):
    """Whole milliseconds of a duration, 0 where it is missing: exact to add up in any order."""
    return F.coalesce(F.round(F.col(c) * 1000).cast("bigint"), F.lit(0).cast("bigint"))


#: The same rows for the SQL side.
SQL = {
    "t": "t AS (SELECT * FROM tool_rows QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)",
    "b": "b AS (SELECT * FROM bash_rows QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)",
    "m": "m AS (SELECT * FROM user_msg_rows QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)",
    "s": "s AS (SELECT * FROM session_rows QUALIFY row_number() OVER (PARTITION BY sid ORDER BY ingested_at DESC) = 1)",
    "l": "l AS (SELECT line_id, any_value(sid) AS sid, any_value(line_no) AS line_no, any_value(kind) AS kind, any_value(raw) AS raw FROM transcript_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY line_id)",
}


def with_facts(names: str, body: str) -> str:
    """SQL over the facts named by the letters t, b, m, s, l."""
    return "WITH " + ", ".join(SQL[n] for n in names) + ("" if body.startswith(",") else " ") + body


def sql_half_up(x: str, digits: int = 0) -> str:
    return f"floor(({x})::DOUBLE * {10**digits}::DOUBLE + 0.5) / {10**digits}::DOUBLE"


SQL_MS = 'coalesce(CAST(round("durSec" * 1000) AS BIGINT), 0)'
