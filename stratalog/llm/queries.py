"""Queries p1 and p6 to p10, with the SQL that checks them where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import language, leaks, pii, req, runs, tokenize

QUANTILES, NAMES = [0.5, 0.9, 0.95, 0.99], ["median", "p90", "p95", "p99"]


#: Where the public vocabularies lie; a parameter, never copied here.
VOCABULARY = os.environ.get("STRATALOG_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse(table(spark, sf, "bash_rows"), least=2, texts=False).select("sid", "low_row_id", "high_row_id")


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse(table(spark, sf, "bash_rows"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("ingested_at")
    bash, tool = ((t, k, v) for t, k, v in (("bash_rows", "family", "durSec"), ("tool_rows", "tool", "outChars")))
    return req.distinct_values(table(spark, sf, bash[0]), *bash, day).unionByName(req.distinct_values(table(spark, sf, tool[0]), *tool, day))


def p6_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Every day's quantiles, and (day null) those of all days, merged from the days' summaries."""
    days = req.sketch_days(_values(spark, sf))
    return req.read_quantiles(days.unionByName(req.merge_days(days)), QUANTILES, NAMES)


def p6_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The quantiles of p6_quantiles whose summaries hold every value, so that they are exact."""
    return p6_quantiles(spark, sf).where(F.col("n") <= req.EXACT)


def p6_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Per table: keys, and whether every quantile's exact rank lies within the stated bound of the wanted one."""
    values = _values(spark, sf)
    read = req.read_quantiles(req.merge_days(req.sketch_days(values)), QUANTILES, NAMES).drop("day")
    v = values.where("value is not null and not isnan(value)").select("tbl", F.col("key_value").alias("k"), "value")
    met = v.join(read, (v["tbl"] == read["tbl"]) & v["k"].eqNullSafe(read["key_value"])).drop(v["tbl"])
    ranks = met.groupBy("tbl", "key_value", "n").agg(*[c for name in NAMES for c in (F.count_if(F.col("value") < F.col(name)).alias(f"{name}_lt"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_le"))])
    ok = F.lit(True)
    for p, name in zip(QUANTILES, NAMES):
        want = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))
        off = F.greatest(F.lit(0), F.col(f"{name}_lt") + 1 - want, want - F.col(f"{name}_le"))
        ok = ok & (off <= req.EPS * (F.col("n") - want + 1))
    return ranks.groupBy("tbl").agg(F.count("*").alias("keys"), F.bool_and(ok).alias("within"))


def texts_with_people(spark: SparkSession, sf: str) -> DataFrame:
    bash = table(spark, sf, "bash_rows")
    return pii.gather({("user_msg_rows", "text"): table(spark, sf, "user_msg_rows"), ("bash_rows", "cmd"): bash, ("bash_rows", "out"): bash})


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(texts_with_people(spark, sf))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of the distinct rows, readable, with placeholders."""
    return pii.sanitise(texts_with_people(spark, sf)).distinct()


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode(table(spark, sf, "documents"), VOCABULARY)


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of every document's ids decoded again; its SQL takes that of the text."""
    back = tokenize.decode(tokenize.encode(table(spark, sf, "documents"), VOCABULARY), VOCABULARY)
    return back.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every test item with the number of documents that leak it."""
    found = p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    items = table(spark, sf, "eval_items").select("item_id", "suite").distinct()
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_docs"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.mislabelled(docs, language.train(docs))


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.passages(docs, language.train(docs))


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.document_languages(docs, language.passages(docs, language.train(docs)))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p6_quantiles, p6_exact, p6_bound, p7_found, p7_clean, p8_ids, p8_decoded, p9_found, p9_items, p10_found, p10_passages, p10_documents)}
_DAYS = """v AS (SELECT 'bash_rows' AS tbl, family AS key_value, min(CAST(ingested_at AS DATE)) AS day, max(CAST("durSec" AS DOUBLE)) AS value FROM bash_rows GROUP BY row_id, family
    UNION ALL SELECT 'tool_rows', tool, min(CAST(ingested_at AS DATE)), max(CAST("outChars" AS DOUBLE)) FROM tool_rows GROUP BY row_id, tool),
  k AS (SELECT *, row_number() OVER (PARTITION BY tbl, key_value, day ORDER BY value) AS r, count(*) OVER (PARTITION BY tbl, key_value, day) AS n FROM v WHERE value IS NOT NULL AND NOT isnan(value)
    UNION ALL SELECT tbl, key_value, NULL, value, row_number() OVER (PARTITION BY tbl, key_value ORDER BY value), count(*) OVER (PARTITION BY tbl, key_value) FROM v WHERE value IS NOT NULL AND NOT isnan(value))"""
_AT = ", ".join(f"min(value) FILTER (r >= {p}::DOUBLE * n) AS {name}" for p, name in zip(QUANTILES, NAMES))
ORACLES = {
    "p6_exact": f"WITH {_DAYS} SELECT tbl, key_value, day, n, {_AT} FROM k WHERE n <= {req.EXACT} GROUP BY tbl, key_value, day, n",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
