"""Top-k reports that say what they left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(df: DataFrame, metric: str, tie: str, top: int) -> DataFrame:
    """The `top` rows by metric descending, then tie ascending, each with the number of rows there were (`total`).

    TakeOrdered keeps `top` rows a task; the total is one number, broadcast. Nulls rank last, null ties first.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc_nulls_first()).limit(top).crossJoin(F.broadcast(total))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def mode(value: str, count: str) -> Column:
    """Aggregate over (value, count) rows: the most frequent value, the smallest on ties."""
    return F.min_by(value, F.struct(-F.col(count), F.col(value)))


def shortest(value: str) -> Column:
    """Aggregate: the shortest string, the smallest on ties."""
    return F.min_by(value, F.struct(F.length(value), F.col(value)))
