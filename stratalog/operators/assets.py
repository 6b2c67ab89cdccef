"""Listed assets with versions: filter, resolve, show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(assets: DataFrame, folder: str | None = None, name: str | None = None, visibility: str | None = None) -> DataFrame:
    """Assets in exactly that folder, with that in their name whatever its case, of that visibility; None asks for nothing."""
    df = assets
    if folder is not None:
        df = df.where(F.coalesce("folder", F.lit("")) == folder)
    if name is not None:
        df = df.where(F.contains(F.lower("filename"), F.lit(name.lower())))
    return df if visibility is None else df.where(F.col("visibility") == visibility)


def current_version(versions: Column, current: Column) -> Column:
    """The version struct whose id is the current one; null when it isn't among them."""
    return F.try_element_at(F.filter(versions, lambda v: v.id == current), F.lit(1))


def resolve(assets: DataFrame, wanted: str) -> dict:
    """The one asset of that id, or the only one with that in its name; otherwise an error that lists the candidates (ten at most)."""
    rows = assets.where(F.col("id") == wanted).limit(2).collect() or select(assets, name=wanted).orderBy("filename", "id").limit(11).collect()
    if len(rows) != 1:
        raise LookupError(f"{wanted}: {len(rows) and 'several assets: ' + ', '.join(r.filename for r in rows[:10]) or 'no asset'}")
    return rows[0].asDict(recursive=True)


def tsv(*columns: Column) -> Column:
    """Columns as one tab-separated line, a dash for null."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("-")) for c in columns])
