"""Facts from raw transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans import fleet
from stratalog.plans.catalogue import Catalogue
from stratalog.sources import transcripts as X
from stratalog.sources.facts import distinct_rows, with_facts
from stratalog.sources.tables import table

query = Catalogue()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_rows(table(spark, sf, "transcript_lines"), "line_id").select("line_id", "sid", "line_no", "kind", "raw")


def _s(path: str) -> str:
    return f"json_extract_string(raw, '$.{path}')"


_TYPE = _s("type")
_TOKENS = {"input_tokens": "in", "output_tokens": "out", "cache_read_input_tokens": "cr", "cache_creation_input_tokens": "cc"}


def _num(path: str) -> str:
    return f"coalesce(CASE WHEN json_type(raw, '$.{path}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(raw, '$.{path}') AS BIGINT) END, 0)"


_TURNS = f"""u AS (SELECT sid, line_no, line_id, coalesce({_s('requestId')}, {_s('message.id')}, 'line-' || line_no) AS request, {_s('message.model')} AS model,
    {', '.join(f'{_num("message.usage." + c)} AS "{a}"' for c, a in _TOKENS.items())}
    FROM l WHERE {_TYPE} = 'assistant' AND json_type(raw, '$.message.usage') = 'OBJECT'),
  d AS (SELECT *, "in" + cr + cc AS ctx FROM u QUALIFY row_number() OVER (PARTITION BY sid, request ORDER BY line_no) = 1)"""


def _fold(path: str, how: str) -> str:
    return f"{how}({_s(path)}, line_no) FILTER (coalesce({_s(path)}, '') <> '')"


@query(with_facts("l", f"""SELECT sid, {_fold('cwd', 'arg_min')} AS cwd, {_fold('gitBranch', 'arg_max')} AS branch, {_fold('version', 'arg_max')} AS ver, {_fold('timestamp', 'arg_min')} AS first_ts, {_fold('timestamp', 'arg_max')} AS last_ts,
  count(*) FILTER ({_TYPE} = 'assistant') AS assistant_msgs, count(*) FILTER ({_TYPE} = 'user') AS user_msgs FROM l GROUP BY sid"""))
def fact_session_fold(spark: SparkSession, sf: str) -> DataFrame:
    return X.session_fold(X.parse(lines(spark, sf)))


@query(with_facts("l", f""", {_TURNS} SELECT sid, count(*) AS turns, CAST(sum("in") AS BIGINT) AS in_tokens, CAST(sum("out") AS BIGINT) AS out_tokens, CAST(sum(cr) AS BIGINT) AS cache_read, CAST(sum(cc) AS BIGINT) AS cache_create,
  max(ctx) AS max_ctx, arg_min(cc, line_no) AS first_turn_cache_create FROM d GROUP BY sid"""))
def fact_turn_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return X.session_tokens(X.turns(X.parse(lines(spark, sf))))


@query(with_facts("l", f", {_TURNS} SELECT sid, model, count(*) AS n FROM d WHERE model <> '' GROUP BY ALL"))
def fact_models(spark: SparkSession, sf: str) -> DataFrame:
    return X.turns(X.parse(lines(spark, sf))).where("model <> ''").groupBy("sid", "model").agg(F.count("*").alias("n"))


_BLOCKS = """k AS (SELECT sid, line_no, raw, CASE WHEN json_type(raw, '$.message.content') = 'ARRAY' THEN CAST(json_extract(raw, '$.message.content') AS JSON[]) END AS bs FROM l),
  x AS (SELECT sid, line_no, raw, unnest(range(len(bs))) AS pos, unnest(bs) AS b FROM k),
  o AS (SELECT *, json_extract_string(b, '$.type') AS kind FROM x WHERE json_type(b) = 'OBJECT')"""


@query(with_facts("l", f", {_BLOCKS} SELECT sid, json_extract_string(b, '$.name') AS tool, count(*) AS n FROM o WHERE kind = 'tool_use' AND json_type(b, '$.name') = 'VARCHAR' GROUP BY ALL"))
def fact_tool_map(spark: SparkSession, sf: str) -> DataFrame:
    calls = X.content_blocks(lines(spark, sf)).where("kind = 'tool_use' and name is not null")
    return calls.groupBy("sid", F.col("name").alias("tool")).agg(F.count("*").alias("n"))


_MS = "CASE WHEN json_type(raw, '$.timestamp') = 'VARCHAR' THEN epoch_ms(try_cast(json_extract_string(raw, '$.timestamp') AS TIMESTAMPTZ)) END"


@query(with_facts("l", f""", {_BLOCKS},
  c AS (SELECT sid, json_extract_string(b, '$.id') AS id, json_extract_string(b, '$.name') AS tool, {_MS} AS ms FROM o WHERE kind = 'tool_use' AND json_type(b, '$.id') = 'VARCHAR' QUALIFY row_number() OVER (PARTITION BY sid, id ORDER BY line_no, pos) = 1),
  r AS (SELECT sid, json_extract_string(b, '$.tool_use_id') AS id, {_MS} AS ms, coalesce(json_extract(b, '$.is_error') = 'true', false) AS err FROM o WHERE kind = 'tool_result' AND json_type(b, '$.tool_use_id') = 'VARCHAR' QUALIFY row_number() OVER (PARTITION BY sid, id ORDER BY line_no, pos) = 1)
  SELECT sid, id, coalesce(c.tool, 'unknown') AS tool, CASE WHEN c.id IS NOT NULL AND r.ms IS NOT NULL AND c.ms IS NOT NULL THEN greatest(0, r.ms - c.ms) / 1000.0::DOUBLE END AS dur_sec, coalesce(r.err, false) AS err, r.id IS NULL AS open
  FROM c FULL JOIN r USING (sid, id)"""))
def fact_call_result_join(spark: SparkSession, sf: str) -> DataFrame:
    return X.call_results(X.content_blocks(lines(spark, sf))).select("sid", "id", "tool", "dur_sec", "err", "open")


@query(with_facts("l", rf"""SELECT sid, count(*) FILTER ({_TYPE} = 'user' AND coalesce(json_extract(raw, '$.toolUseResult.interrupted') = 'true', false))
  + count(*) FILTER ({_TYPE} = 'user' AND contains(coalesce(CAST(json_extract(raw, '$.message.content') AS VARCHAR), ''), '[Request interrupted')) AS interrupts FROM l GROUP BY sid"""))
def fact_interrupts(spark: SparkSession, sf: str) -> DataFrame:
    return X.interrupts(X.parse(lines(spark, sf)))


_FLAT = """CASE WHEN json_type(b, '$.content') = 'ARRAY' THEN array_to_string(list_transform(CAST(json_extract(b, '$.content') AS JSON[]), lambda x: CASE WHEN json_extract_string(x, '$.type') = 'text' THEN coalesce(json_extract_string(x, '$.text'), '') ELSE '' END), chr(10))
    ELSE coalesce(json_extract_string(b, '$.content'), '') END"""
_CALLS = f""", {_BLOCKS},
  c AS (SELECT sid, json_extract_string(b, '$.id') AS id, json_extract_string(b, '$.name') AS tool, json_extract(b, '$.input') AS input, {_MS} AS ms FROM o WHERE kind = 'tool_use' AND json_type(b, '$.id') = 'VARCHAR' QUALIFY row_number() OVER (PARTITION BY sid, id ORDER BY line_no, pos) = 1),
  e AS (SELECT sid, json_extract_string(b, '$.tool_use_id') AS id, {_MS} AS ms, coalesce(json_extract(b, '$.is_error') = 'true', false) AS err, raw, {_FLAT} AS flat
    FROM o WHERE kind = 'tool_result' AND json_type(b, '$.tool_use_id') = 'VARCHAR' QUALIFY row_number() OVER (PARTITION BY sid, id ORDER BY line_no, pos) = 1),
  r AS (SELECT sid, id, ms, err, CASE WHEN flat = '' AND json_type(raw, '$.toolUseResult') = 'OBJECT' THEN coalesce(json_extract_string(raw, '$.toolUseResult.stdout'), '') || coalesce(json_extract_string(raw, '$.toolUseResult.stderr'), '') ELSE flat END AS text FROM e),
  t AS (SELECT sid, id, coalesce(c.tool, 'unknown') AS tool, c.input, coalesce(c.ms, r.ms) AS t_ms, CASE WHEN c.id IS NOT NULL AND r.ms IS NOT NULL AND c.ms IS NOT NULL THEN greatest(0, r.ms - c.ms) / 1000.0::DOUBLE END AS dur_sec,
    coalesce(r.err, false) AS err, coalesce(r.text, '') AS text, length(coalesce(r.text, '')) + length(regexp_replace(coalesce(r.text, ''), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS out_chars FROM c FULL JOIN r USING (sid, id))"""


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return X.call_results(X.content_blocks(lines(spark, sf)))


@query(with_facts("l", _CALLS + " SELECT sid, id, tool, t_ms, dur_sec, err, out_chars FROM t"))
def fact_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Tool rows with the size of the whole output."""
    return _calls(spark, sf).select("sid", "id", "tool", "t_ms", "dur_sec", "err", "out_chars")


@query()
def fact_tool_args(spark: SparkSession, sf: str) -> DataFrame:
    return _calls(spark, sf).select("sid", "id", "tool", "arg")


_INPUT = lambda k: f"json_extract_string(input, '$.{k}')"


@query(with_facts("l", _CALLS + f""" SELECT sid, id, coalesce({_INPUT('command')}, {_INPUT('cmd')}, '') AS cmd, {_INPUT('description')} AS descr, err, out_chars, substring(text, 1, CASE WHEN err THEN {X.OUT_ERR} ELSE {X.OUT_OK} END) AS out FROM t WHERE tool = 'Bash'"""))
def fact_bash(spark: SparkSession, sf: str) -> DataFrame:
    """Shell rows; their family, program and background flag are those of normalize_command."""
    return X.bash_rows(_calls(spark, sf)).select("sid", "id", "cmd", F.col("desc").alias("descr"), "err", "out_chars", "out")


@query(with_facts("l", _CALLS + f" SELECT sid, id, tool, substring(text, 1, {X.ERROR}) AS msg FROM t WHERE err"))
def fact_error(spark: SparkSession, sf: str) -> DataFrame:
    return X.error_rows(_calls(spark, sf)).select("sid", "id", "tool", "msg")


@query(with_facts("l", _CALLS + f""", w AS (SELECT sid, tool, substring(text, 1, {X.ERROR}) AS out FROM t WHERE err), v AS (SELECT sid, tool, {fleet._SIG} AS sig FROM w),
  m AS (SELECT sig, tool, count(*) AS k FROM v GROUP BY ALL), g AS (SELECT sig, count(*) AS n, count(DISTINCT sid) AS sessions FROM v GROUP BY sig)
  SELECT g.sig, n, sessions, (SELECT arg_min(tool, (-k, tool)) FROM m WHERE m.sig = g.sig) AS top_tool FROM g"""))
def fact_error_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of all tools by signature, with the tool that fails so most often."""
    rows = X.error_rows(_calls(spark, sf)).select("sid", F.lit(None).cast("string").alias("proj"), "tool", "msg")
    return fleet.clusters(rows).select("sig", "n", "sessions", "top_tool")


@query()
def fact_user_msg(spark: SparkSession, sf: str) -> DataFrame:
    src = lines(spark, sf)
    kinds = src.select("sid", F.col("kind").alias("_kind")).distinct()
    blocks = X.content_blocks(src).join(kinds, "sid", "left")
    return X.user_messages(blocks, F.col("_kind"))


QUERIES, ORACLES = query.queries, query.oracles
