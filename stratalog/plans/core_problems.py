"""Queries p2 to p5: drift, skew, orphans and nesting over the transcript tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import drift, nested, orphans, skew
from stratalog.sources.tables import table

KEYS = (("tool_rows", "tool", "row_id"), ("bash_rows", "family", "row_id"), ("session_rows", "proj", "sid"))
HEAVY_SHARE = 0.05


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "transcript_lines"), table(spark, sf, "line_contract"))


def _landed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines, contract = table(spark, sf, "transcript_lines"), table(spark, sf, "line_contract")
    pairs = drift.renames(drift.checkpointed(drift.facts(lines, drift.Contract(contract))))
    return drift.land(lines, contract, pairs), contract


def p2_landed(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of every landed line, as delivered; texts of objects and arrays are left out here, as engines write them differently."""
    rows = drift.as_delivered(_landed(spark, sf)[0])
    return rows.withColumn("value", F.when(F.col("json_type").isin("string", "boolean", "number"), F.col("value")))


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    """The one table: a line a row, a contract path a column in its type, the rest in one field."""
    return drift.wide(*_landed(spark, sf))


def p2_union(spark: SparkSession, sf: str) -> DataFrame:
    """Every JSON type that each path has, by line type."""
    return drift.union(drift.alternatives(table(spark, sf, "transcript_lines"), table(spark, sf, "line_contract")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [skew.heavy_keys(table(spark, sf, t), col, order, HEAVY_SHARE).select(F.lit(t).alias("tbl"), F.lit(col).alias("col"), "key_value") for t, col, order in KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, errors, milliseconds and characters of each tool, family and project, whatever its share."""
    out = None
    for t, col, order in KEYS:
        df = table(spark, sf, t)
        if t == "session_rows":
            measures = {"errors": F.col("errors"), "msecs": (F.col("end") - F.col("start")) * 1000, "chars": F.col("outTokens")}
        else:
            measures = {"errors": F.col("err").cast("bigint"), "msecs": F.round(F.col("durSec") * 1000).cast("bigint"), "chars": F.col("outChars")}
        part = skew.per_key(df, col, order, measures).select(F.lit(t).alias("tbl"), "key_value", "n", *measures)
        out = part if out is None else out.unionByName(part)
    return out


def p4_orphans(spark: SparkSession, sf: str) -> DataFrame:
    facts = {t: table(spark, sf, t) for t in ("tool_rows", "bash_rows", "user_msg_rows")}
    return orphans.find_orphans(table(spark, sf, "transcript_lines"), table(spark, sf, "session_rows"), facts)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_orphans(spark, sf).select("src", "sid", "ref").distinct()


def p4_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return p4_orphans(spark, sf).groupBy("src", "period").agg(F.countDistinct("sid", "ref").alias("n_orphans"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.children(table(spark, sf, "transcript_lines"))


def _flat(spark: SparkSession, sf: str, tag: str) -> DataFrame:
    return nested.flat_table(nested.flatten(table(spark, sf, "transcript_lines")), tag)


def p5_line(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "line").select("line_id", "type", "timestamp", "sessionId", "uuid", "requestId")


def p5_block(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "block").select("line_id", "path", "parent_path", "type", "id", "name", "tool_use_id", F.col("is_error"), F.length("text").alias("n_text"))


def p5_result(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "result").select("line_id", "stdout", "stderr", "interrupted")


def p5_usage(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "usage").select("line_id", *[c.split()[0] for c in nested.SCHEMAS["usage"].split(", ")])


QUERIES = {f.__name__: f for f in (p2_found, p2_landed, p2_table, p2_union, p3_found, p3_per_key, p4_found, p4_per_month, p5_found, p5_line, p5_block, p5_result, p5_usage)}


def _heavy(t: str, col: str, order: str) -> str:
    rows = f"(SELECT DISTINCT {order}, {col} FROM {t})"
    return f"SELECT '{t}' AS tbl, '{col}' AS col, {col} AS key_value FROM {rows} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM {rows})"


def _per_key(t: str, col: str, order: str) -> str:
    m = '"errors" AS e, ("end" - "start") * 1000 AS ms, "outTokens" AS ch' if t == "session_rows" else 'err::BIGINT AS e, CAST(round("durSec" * 1000) AS BIGINT) AS ms, "outChars" AS ch'
    inner = f"SELECT {col} AS k, {order}, max(e) AS e, max(ms) AS ms, max(ch) AS ch FROM (SELECT {col}, {order}, {m} FROM {t}) GROUP BY ALL"
    return f"SELECT '{t}' AS tbl, k AS key_value, count(*) AS n, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(ms) AS BIGINT) AS msecs, CAST(sum(ch) AS BIGINT) AS chars FROM ({inner}) GROUP BY k"


_BLOCK = "json_extract_string(b, '$.type')"
_PERIOD = "strftime(ingested_at, '%Y-%m')"
_LINES = "(SELECT sid, ingested_at, raw FROM transcript_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')"
_NESTED = f"""
  SELECT sid, ingested_at, b FROM (SELECT sid, ingested_at, unnest(CASE WHEN json_type(raw, '$.message.content') = 'ARRAY' THEN CAST(json_extract(raw, '$.message.content') AS JSON[]) END) AS b FROM {_LINES})"""
_CALLS = f"""calls AS (WITH RECURSIVE blocks AS ({_NESTED}
    UNION ALL SELECT sid, ingested_at, unnest(CASE WHEN json_type(b, '$.content') = 'ARRAY' THEN CAST(json_extract(b, '$.content') AS JSON[]) END) FROM blocks)
  SELECT sid, {_PERIOD} AS period, {_BLOCK} AS kind, json_extract_string(b, '$.tool_use_id') AS ref, json_extract_string(b, '$.id') AS id FROM blocks WHERE json_type(b) = 'OBJECT')"""
_ORPHANS = f"""WITH {_CALLS}, sids AS (
    SELECT 'tool_rows' AS src, sid, {_PERIOD} AS period FROM tool_rows UNION ALL SELECT 'bash_rows', sid, {_PERIOD} FROM bash_rows
    UNION ALL SELECT 'user_msg_rows', sid, {_PERIOD} FROM user_msg_rows UNION ALL SELECT 'transcript_lines', sid, {_PERIOD} FROM transcript_lines), orphans AS (
  SELECT DISTINCT 'tool_result' AS src, sid, ref, period FROM calls c WHERE kind = 'tool_result' AND ref IS NOT NULL AND sid IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM calls u WHERE u.kind = 'tool_use' AND u.sid = c.sid AND u.id = c.ref)
  UNION ALL SELECT DISTINCT src, sid, sid, period FROM sids WHERE sid IS NOT NULL AND sid NOT IN (SELECT sid FROM session_rows WHERE sid IS NOT NULL)
  UNION ALL SELECT DISTINCT 'session_rows', sid, parent, {_PERIOD} FROM session_rows WHERE sid IS NOT NULL AND parent IS NOT NULL AND parent NOT IN (SELECT sid FROM session_rows WHERE sid IS NOT NULL))
"""
_STATED = "(SELECT line_type FROM line_contract)"
_DELIVERED = f"""WITH RECURSIVE lines AS (SELECT line_id, any_value(sid) AS sid, any_value(raw) AS raw FROM transcript_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY line_id),
  opened AS (
    SELECT line_id, sid, coalesce({', '.join(f"CASE WHEN json_extract_string(raw, '$.{p}') IN {_STATED} THEN json_extract_string(raw, '$.{p}') END" for p in ('type', 'type.name', 'lineType'))}) AS line_type,
      '' AS parent, CAST(raw AS JSON) AS o FROM lines
    UNION ALL
    SELECT line_id, sid, k.line_type, k.path, v FROM (
      SELECT line_id, sid, line_type, CASE WHEN parent = '' THEN key ELSE parent || '.' || key END AS path, json_extract(o, '$."' || key || '"') AS v FROM (SELECT *, unnest(json_keys(o)) AS key FROM opened)) k
      JOIN line_contract c ON c.line_type = k.line_type AND c.path = k.path AND list_contains(string_split(c.json_types, '|'), 'object') WHERE json_type(v) = 'OBJECT' AND CAST(v AS VARCHAR) <> '{{}}' AND k.path <> 'message.content'),
  found AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS json_type FROM (
      SELECT line_id, sid, line_type, CASE WHEN parent = '' THEN key ELSE parent || '.' || key END AS path, json_extract(o, '$."' || key || '"') AS v FROM (SELECT *, unnest(json_keys(o)) AS key FROM opened))),
  delivered AS (SELECT line_id, sid, f.line_type, f.path, f.json_type, v, c.path IS NOT NULL AND (f.json_type = 'null' OR list_contains(string_split(c.json_types, '|'), f.json_type)) AS agreed
    FROM found f LEFT JOIN line_contract c ON c.line_type = f.line_type AND c.path = f.path
    WHERE NOT (c.path IS NOT NULL AND f.json_type = 'object' AND list_contains(string_split(c.json_types, '|'), 'object') AND CAST(v AS VARCHAR) <> '{{}}' AND f.path <> 'message.content'))
"""
_P5 = f"""WITH RECURSIVE lines AS (SELECT line_id, any_value(raw) AS raw FROM transcript_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY line_id),
  tops AS (SELECT line_id, CAST(json_extract(raw, '$.message.content') AS JSON[]) AS bs FROM lines WHERE json_type(raw, '$.message.content') = 'ARRAY'),
  blocks AS (
    SELECT line_id, CAST(i AS VARCHAR) AS path, '' AS parent_path, bs[i + 1] AS b FROM (SELECT line_id, bs, unnest(range(len(bs))) AS i FROM tops)
    UNION ALL
    SELECT line_id, parent || '.' || CAST(i AS VARCHAR), parent, bs[i + 1] FROM (
      SELECT line_id, path AS parent, CAST(json_extract(b, '$.content') AS JSON[]) AS bs, unnest(range(CAST(json_array_length(b, '$.content') AS BIGINT))) AS i FROM blocks WHERE json_type(b, '$.content') = 'ARRAY'))
  SELECT line_id, path, parent_path, CASE WHEN json_type(b) = 'VARCHAR' THEN 'text' ELSE coalesce(json_extract_string(b, '$.type'), '') END AS kind FROM blocks
  UNION ALL SELECT line_id, '0', '', 'text' FROM lines WHERE json_type(raw, '$.message.content') = 'VARCHAR'
  UNION ALL SELECT line_id, 'usage', '', 'usage' FROM lines WHERE json_type(raw, '$.message.usage') = 'OBJECT'
  UNION ALL SELECT line_id, 'toolUseResult', '', 'toolUseResult' FROM lines WHERE json_type(raw, '$.toolUseResult') = 'OBJECT'"""

_P5_LINES = "(SELECT line_id, any_value(raw) AS raw FROM transcript_lines WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY line_id)"


def _typed(src: str, path: str, types: str, cast: str) -> str:
    return f"CASE WHEN json_type({src}, '$.{path}') IN ({types}) THEN CAST(json_extract_string({src}, '$.{path}') AS {cast}) END AS {path.rpartition('.')[2]}"


_TEXT = lambda src, path: f"json_extract_string({src}, '$.{path}') AS \"{path.rpartition('.')[2]}\""
_P5_USAGE = f"""SELECT line_id, {", ".join(_typed("raw", f"message.usage.{c.split()[0]}", "'UBIGINT', 'BIGINT'", "BIGINT") for c in nested.SCHEMAS["usage"].split(", "))}
  FROM {_P5_LINES} WHERE json_type(raw, '$.message.usage') = 'OBJECT'"""
_P5_LINE = f"SELECT line_id, {', '.join(_TEXT('raw', c) for c in ('type', 'timestamp', 'sessionId', 'uuid', 'requestId'))} FROM {_P5_LINES}"
_P5_RESULT = f"""SELECT line_id, {_TEXT("raw", "toolUseResult.stdout")}, {_TEXT("raw", "toolUseResult.stderr")}, {_typed("raw", "toolUseResult.interrupted", "'BOOLEAN'", "BOOLEAN")} FROM {_P5_LINES} WHERE json_type(raw, '$.toolUseResult') = 'OBJECT'"""
_P5_BLOCK = f"""{_P5.split("SELECT line_id, path, parent_path, CASE WHEN json_type(b)")[0]}
  SELECT line_id, path, parent_path, CASE WHEN json_type(b) = 'OBJECT' THEN json_extract_string(b, '$.type') END AS type, json_extract_string(b, '$.id') AS id, json_extract_string(b, '$.name') AS name, json_extract_string(b, '$.tool_use_id') AS tool_use_id,
    CASE WHEN json_type(b, '$.is_error') = 'BOOLEAN' THEN CAST(json_extract_string(b, '$.is_error') AS BOOLEAN) END AS is_error, length(CASE WHEN json_type(b) = 'OBJECT' THEN json_extract_string(b, '$.text') ELSE json_extract_string(b, '$') END) AS n_text FROM blocks
  UNION ALL SELECT line_id, '0', '', NULL, NULL, NULL, NULL, NULL, length(json_extract_string(raw, '$.message.content')) FROM lines WHERE json_type(raw, '$.message.content') = 'VARCHAR'"""

ORACLES = {
    "p2_landed": _DELIVERED + "SELECT line_id, line_type, path, json_type, agreed, CASE WHEN json_type IN ('string', 'boolean', 'number') THEN json_extract_string(v, '$') END AS value FROM delivered",
    "p2_union": _DELIVERED + "SELECT line_type, path, json_type, agreed, count(*) AS n_lines, count(DISTINCT sid) AS n_files FROM delivered GROUP BY ALL",
    "p5_usage": _P5_USAGE,
    "p5_line": _P5_LINE,
    "p5_result": _P5_RESULT,
    "p5_block": _P5_BLOCK,
    "p3_found": " UNION ALL ".join(_heavy(*k) for k in KEYS),
    "p3_per_key": " UNION ALL ".join(_per_key(*k) for k in KEYS),
    "p4_found": _ORPHANS + "SELECT DISTINCT src, sid, ref FROM orphans",
    "p4_per_month": _ORPHANS + "SELECT src, period, count(DISTINCT (sid, ref)) AS n_orphans FROM orphans GROUP BY src, period",
    "p5_found": _P5,
}
