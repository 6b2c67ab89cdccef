"""Per-key results when a few keys hold most rows.

Method: rows are range partitioned on the composite (key, secondary order). Spark samples the
composite's quantiles to place the cuts, so a heavy key is cut inside itself and every task gets about
the same number of rows. Equal (key, order) pairs stay together, so repeated deliveries are dropped
inside the partition, without a second shuffle. Each task then leaves one partial state per key; only
keys that straddle a cut have more than one, and stitching adds them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.sources.tables import checkpointed


def partials(df: DataFrame, key: str, order: str, measures: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Distinct rows, balanced: (key_value, order_value, measures).

    measures: name -> Column over df's own columns, evaluated before the shuffle, so nothing else moves.
    Null keys form their own group; rows with a null order value can't be told apart from each other and
    count as one per key. Of repeated deliveries the largest measure counts, whatever order they came in.
    """
    slim = df.select(df[key].alias("key_value"), df[order].alias("order_value"), *[c.alias(n) for n, c in measures.items()])
    by = [F.col("key_value"), F.col("order_value")]
    spread = slim.repartitionByRange(partitions, *by) if partitions else slim.repartitionByRange(*by)
    # RangePartitioning(key, order) already satisfies the clustering this aggregate asks for: no exchange here.
    return spread.groupBy("key_value", "order_value").agg(*[F.max(n).alias(n) for n in measures], F.lit(1).alias("_one"))


def per_key(df: DataFrame, key: str, order: str, measures: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per key: `key_value`, `n` distinct rows, the sum of each measure (nulls add nothing).

    The first aggregate below runs map-side in the balanced partitions; its exchange carries at most
    (keys + partitions) rows, and the final aggregate is the stitching of the boundary states.
    An empty table gives no rows; extra columns are ignored.
    """
    measures = measures or {}
    return partials(df, key, order, measures, partitions).groupBy("key_value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures])


def heavy_keys(df: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """Keys holding at least `share` of the distinct rows: `key_value`, `n`, `total`. Null is no key value, but its rows count in the total.

    The counts are written once, since they are compared with their own sum: else the rows would be read and partitioned for each.
    """
    keys = checkpointed(per_key(df, key, order))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row by construction
    return keys.where("key_value is not null").crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * F.lit(share))
