"""What filled each session's context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import numbers as N
from stratalog.operators import ranking as R
from stratalog.operators import sequences as S
from stratalog.operators import timeline as TL
from stratalog.plans import transcripts as P
from stratalog.plans.catalogue import Catalogue
from stratalog.sources import transcripts as X
from stratalog.sources.facts import sql_half_up, with_facts
from stratalog.sources.tables import checkpointed

query = Catalogue()
ITEMS = 40

_CTX = " + ".join(P._num(f"message.usage.{c}") for c in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))
_TURNS = f"""u AS (SELECT sid, line_no, coalesce({P._s('requestId')}, 'line-' || line_no) AS request, coalesce({P._s('message.model')}, 'unknown') AS model, {_CTX} AS ctx,
    {P._num('message.usage.cache_read_input_tokens')} AS cache_read, {P._num('message.usage.output_tokens')} AS output
    FROM l WHERE {P._TYPE} = 'assistant' AND coalesce({P._s('isSidechain')}, '') <> 'true'),
  d AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY line_no) - 1 AS turn FROM (SELECT * FROM u WHERE ctx > 0 QUALIFY row_number() OVER (PARTITION BY sid, request ORDER BY line_no) = 1))"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return TL.turns(X.parse(P.lines(spark, sf)))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return TL.events(P.lines(spark, sf))


def _sizes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events without their texts, and turns, each written once, since snapshots read them several times."""
    return checkpointed(TL.events(P.lines(spark, sf), bodies=False)), checkpointed(_turns(spark, sf))


@query(with_facts("l", f""", {_TURNS} SELECT sid, max(ctx) AS peak_ctx, CAST(arg_max(turn, (ctx, -turn)) AS INT) AS peak_turn, arg_max(cache_read, (ctx, -turn)) AS peak_cache_read, CAST(sum(output) AS BIGINT) AS total_output,
  arg_max(ctx, turn) AS final_ctx, count(*) AS turns FROM d GROUP BY sid"""))
def sess_peak(spark: SparkSession, sf: str) -> DataFrame:
    return TL.peaks(_turns(spark, sf))


@query(with_facts("l", f", {_TURNS} SELECT sid, CAST(coalesce(min(turn) FILTER (ctx >= 80000), -1) AS INT) AS cross_turn, count(*) FILTER (ctx >= 80000) AS turns_over FROM d GROUP BY sid"))
def sess_dumb_zone(spark: SparkSession, sf: str) -> DataFrame:
    """With a window of 200,000 tokens."""
    return TL.dumb_zone(_turns(spark, sf), window=200_000)


@query(with_facts("l", f""", {_TURNS}, p AS (SELECT sid, max(ctx) AS peak FROM d GROUP BY sid)
  SELECT sid, peak, {sql_half_up('peak / 200000', 4)} AS share, CASE WHEN peak / 200000 < 0.4 THEN 'ok' WHEN peak / 200000 < 0.75 THEN 'warn' ELSE 'bad' END AS zone FROM p"""))
def sess_header(spark: SparkSession, sf: str) -> DataFrame:
    share = F.col("peak_ctx") / 200_000
    return TL.peaks(_turns(spark, sf)).select("sid", F.col("peak_ctx").alias("peak"), N.half_up(share, 4).alias("share"), N.zone(share, TL.LIMIT).alias("zone"))


_COUNTS = f""", k AS (SELECT sid, line_no, {P._TYPE} AS type, raw, CASE WHEN json_type(raw, '$.message.content') = 'ARRAY' THEN CAST(json_extract(raw, '$.message.content') AS JSON[]) END AS bs FROM l),
  e AS (SELECT sid, CASE WHEN json_extract(raw, '$.isCompactSummary') = 'true' THEN 'compaction' ELSE 'user-prompt' END AS kind FROM k WHERE type = 'user' AND json_type(raw, '$.message.content') = 'VARCHAR'
    UNION ALL SELECT sid, CASE json_extract_string(b, '$.type') WHEN 'tool_result' THEN 'tool-result' WHEN 'text' THEN 'user-prompt' END FROM (SELECT sid, unnest(bs) AS b FROM k WHERE type = 'user') WHERE json_type(b) = 'OBJECT'
    UNION ALL SELECT sid, CASE json_extract_string(b, '$.type') WHEN 'thinking' THEN 'assistant-thinking' WHEN 'text' THEN 'assistant-text' WHEN 'tool_use' THEN 'tool-call' END FROM (SELECT sid, unnest(bs) AS b FROM k WHERE type = 'assistant') WHERE json_type(b) = 'OBJECT'
    UNION ALL SELECT sid, type FROM k WHERE type IN ('attachment', 'summary', 'system'))
  SELECT sid, kind, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY ALL"""


@query(with_facts("l", _COUNTS))
def timeline_events(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("sid", "kind").agg(F.count("*").alias("n"))


@query()
def sess_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return TL.snapshots(*_sizes(spark, sf))


@query()
def sess_budget(spark: SparkSession, sf: str) -> DataFrame:
    events, turns = _sizes(spark, sf)
    return TL.budget(TL.snapshots(events, turns), TL.peaks(turns))


@query()
def sess_residual(spark: SparkSession, sf: str) -> DataFrame:
    return TL.residual(*_sizes(spark, sf))


@query()
def sess_thinking(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's output that isn't visible."""
    e = TL.placed(*_sizes(spark, sf)).where("turn is not null")
    seen = F.sum(F.when(F.col("kind").isin("assistant-text", "tool-call"), F.col("tokens")).otherwise(0))
    return e.groupBy("sid", "turn").agg(F.greatest(F.lit(0), F.max("output") - seen).alias("thinking"))


@query()
def turn_ffill(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the turn they fall into: the last one begun, 0 before the first."""
    e = TL.placed(*_sizes(spark, sf))
    return e.select("sid", "line_no", "pos", "kind", F.coalesce(S.forward_fill(F.col("turn"), ["sid"], ["line_no", "pos"]), F.lit(0)).alias("turn"))


@query()
def compaction_turns(spark: SparkSession, sf: str) -> DataFrame:
    return TL.compaction_turns(*_sizes(spark, sf))


@query()
def biggest_items(spark: SparkSession, sf: str) -> DataFrame:
    """The largest events of each session."""
    e = _events(spark, sf).where("kind <> 'system' and tokens > 0").select("sid", "line_no", "pos", "kind", "title", "tokens")
    return R.top_per_group(e, ["sid"], [F.col("tokens").desc(), F.col("line_no").asc(), F.col("pos").asc()], ITEMS)


@query(with_facts("l", f", {_TURNS} SELECT sid, count(*) AS turns, max(ctx) AS peak_ctx FROM d WHERE sid LIKE 'agent-%' GROUP BY sid".replace(" AND coalesce(json_extract_string(raw, '$.isSidechain'), '') <> 'true'", "")))
def subagent_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Turns and peak context of child transcripts."""
    own = TL.turns(X.parse(P.lines(spark, sf)), own_window=True)
    return own.where("sid like 'agent-%'").groupBy("sid").agg(F.count("*").alias("turns"), F.max("ctx").alias("peak_ctx"))


@query()
def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The explorer's history filter: tool results of 50 tokens or more that mention a word."""
    e = _events(spark, sf)
    return e.where((F.col("kind") == "tool-result") & (F.col("tokens") >= 50) & F.contains(F.lower("body"), F.lit("error"))).select("sid", "line_no", "pos", "title", "tokens")


@query()
def loaded_events(spark: SparkSession, sf: str) -> DataFrame:
    """What each session loaded, by category."""
    return _events(spark, sf).where("load is not null").groupBy("sid", "load").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


QUERIES, ORACLES = query.queries, query.oracles
