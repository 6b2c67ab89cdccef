"""Wide events, assets, formats, redaction and command normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import numbers as N
from stratalog.functions import redaction, shell
from stratalog.functions import text as T
from stratalog.operators import assets as A
from stratalog.operators import events as E
from stratalog.plans.catalogue import Catalogue
from stratalog.plans.people import _quote
from stratalog.sources import facts
from stratalog.sources.facts import SQL_MS, sql_half_up, with_facts
from stratalog.sources.tables import table

query = Catalogue()
RATE = 10


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


_E = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"WITH {_E} SELECT event_id FROM e WHERE event_type = 'error' OR value > 100")
def tail_interesting(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).where((F.col("event_type") == "error") | (F.col("value") > 100)).select("event_id")


@query()
def tail_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The events a tail sampler keeps, with their weights; the sampling is the feature."""
    wanted = (F.col("event_type") == "error") | (F.col("value") > 100)
    return _events(spark, sf).where(E.keep(F.col("event_id"), wanted, RATE)).select("event_id", "event_type", E.weight(wanted, RATE).alias("weight"))


@query(f"WITH {_E} SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' OR value > 100 THEN 1 ELSE 10 END) AS BIGINT) AS weighted FROM e GROUP BY event_type")
def weighted_counts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = (F.col("event_type") == "error") | (F.col("value") > 100)
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(E.weight(wanted, RATE)).alias("weighted"))


@query(f"WITH {_E} SELECT DISTINCT user_id FROM e s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.user_id = s.user_id AND event_type = 'purchase')")
def lost_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return E.lost(e.where("event_type = 'signup'").select("user_id").distinct(), e.where("event_type = 'purchase'"), "user_id")


@query(f"WITH {_E} SELECT user_id, count(*) AS hops, min(ts) AS first, max(ts) AS last FROM e WHERE user_id IS NOT NULL GROUP BY user_id")
def hop_stitch(spark: SparkSession, sf: str) -> DataFrame:
    return E.hops(_events(spark, sf), "user_id", "ts")


@query(f"""WITH {_E}, c AS (SELECT count(DISTINCT event_type) AS a, count(DISTINCT user_id) AS b, count(DISTINCT k) AS d FROM e)
  SELECT tag, n, n <= 20 AS ok, (SELECT a::DOUBLE * b * d FROM c) <= 400 AS product_ok FROM (SELECT 'event_type' AS tag, a AS n FROM c UNION ALL SELECT 'user_id', b FROM c UNION ALL SELECT 'k', d FROM c)""")
def tag_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return E.cardinality(_events(spark, sf), ["event_type", "user_id", "k"])


@query(with_facts("st", """, l AS (SELECT DISTINCT sid, unnest(map_keys(tools)) AS tool FROM s WHERE tools IS NOT NULL) SELECT l.sid, l.tool FROM l WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.sid = l.sid AND t.tool = l.tool)"""))
def unused_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Tools that a session counts and no tool row shows."""
    loaded = facts.sessions(spark, sf, "tools").select("sid", F.explode(F.map_keys("tools")).alias("tool"))
    return E.unused(loaded, facts.tools(spark, sf), ["sid", "tool"])


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as assets: brand as folder, name as file name, sizes as versions."""
    version = lambda i: F.struct(F.lit(i).alias("id"), F.concat_ws("/", F.lit("part"), F.col("p_partkey").cast("string"), F.lit(str(i))).alias("url"))
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("folder"), F.col("p_name").alias("filename"), F.when(F.col("p_size") > 25, "public").otherwise("private").alias("visibility"),
        F.array(version(1), version(2), version(3)).alias("versions"), (F.col("p_size") % 4).alias("current"),
    )


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS filename FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND contains(lower(p_name), 'a') AND p_size > 25")
def asset_filter(spark: SparkSession, sf: str) -> DataFrame:
    a = _assets(spark, sf)
    folder = a.agg(F.min("folder")).first()[0]
    return A.select(a, folder=folder or "", name="A", visibility="public").select("id", "filename")


@query("SELECT coalesce(CASE WHEN p_size % 4 > 0 THEN 'part/' || p_partkey || '/' || p_size % 4 END, '-') || chr(9) || p_name AS row FROM part")
def asset_current_version(spark: SparkSession, sf: str) -> DataFrame:
    url = A.current_version(F.col("versions"), F.col("current"))["url"]
    return _assets(spark, sf).select(A.tsv(url, F.col("filename")).alias("row"))


_FIX = lambda x, d: f"printf('%.{d}f', {sql_half_up(x, d)})"


@query(with_facts("s", f"""SELECT sid, CASE WHEN x < 1000 THEN CAST(x AS VARCHAR) WHEN x < 1000000 THEN {_FIX('x / 1000', 1)} || 'k' ELSE {_FIX('x / 1000000', 2)} || 'M' END AS short,
  CASE WHEN x < 1000 THEN CAST(x AS VARCHAR) WHEN x < 10000 THEN {_FIX('x / 1000', 1)} || 'k' WHEN x < 1000000 THEN {_FIX('x / 1000', 0)} || 'k' ELSE {_FIX('x / 1000000', 2)} || 'M' END AS thousands, format('{{:,}}', x) AS long
  FROM (SELECT sid, "cacheReadTokens" AS x FROM s WHERE "cacheReadTokens" IS NOT NULL)"""))
def fmt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("cacheReadTokens")
    return facts.sessions(spark, sf, "cacheReadTokens").where(x.isNotNull()).select("sid", N.tokens_short(x).alias("short"), N.thousands_short(x).alias("thousands"), N.grouped(x).alias("long"))


@query(with_facts("t", f"""SELECT row_id, CASE WHEN x < 90 THEN {_FIX('x', 1)} || 's' WHEN x < 5400 THEN {_FIX('x / 60', 1)} || 'm' ELSE {_FIX('x / 3600', 1)} || 'h' END AS short,
  CASE WHEN x <= 0 THEN '—' WHEN r >= 3600 THEN (r // 3600) || 'h ' || (r // 60 % 60) || 'm' WHEN r >= 60 THEN (r // 60) || 'm ' || (r % 60) || 's' ELSE r || 's' END AS words
  FROM (SELECT row_id, ms / 1000.0::DOUBLE AS x, CAST(floor(ms / 1000.0::DOUBLE + 0.5) AS BIGINT) AS r FROM (SELECT row_id, {SQL_MS} AS ms FROM t WHERE "durSec" IS NOT NULL))"""))
def fmt_seconds(spark: SparkSession, sf: str) -> DataFrame:
    t = facts.tools(spark, sf).where("durSec is not null").select("row_id", (facts.msecs() / 1000.0).alias("x"))
    return t.select("row_id", N.seconds_short(F.col("x")).alias("short"), N.duration_words(F.col("x")).alias("words"))


@query(with_facts("s", f"SELECT sid, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN {_FIX('bytes / 1024', 1)} || ' KB' ELSE {_FIX('bytes / 1048576', 1)} || ' MB' END AS size FROM s WHERE bytes IS NOT NULL"))
def fmt_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return facts.sessions(spark, sf, "bytes").where("bytes is not null").select("sid", N.bytes_short(F.col("bytes")).alias("size"))


@query(with_facts("s", """SELECT sid, CASE WHEN start > 0 THEN strftime(make_timestamp(start * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') ELSE '' END AS begun FROM s"""))
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    return facts.sessions(spark, sf, "start").select("sid", F.coalesce(N.iso_of(F.col("start")), F.lit("")).alias("begun"))


_SHAPES = "text"
for _p, _ in redaction.SHAPES:
    if "(?!" not in _p:  # RE2 has no lookahead
        _SHAPES = f"regexp_replace({_SHAPES}, {_quote(_p)}, '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha1({_SHAPES}) AS sha FROM documents WHERE text IS NOT NULL")
def redact_simple(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with provider-shaped tokens masked in the JVM (the shapes that any regex engine knows)."""
    text = F.col("text")
    for p, _ in redaction.SHAPES:
        if "(?!" not in p:
            text = F.regexp_replace(text, p, "[REDACTED]")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(text.cast("binary")).alias("sha"))


@query()
def redact_full(spark: SparkSession, sf: str) -> DataFrame:
    """Shell calls with all rules applied to command and output, in both dialects."""
    plain, labelled = redaction.redact_udf(), redaction.redact_udf(redaction.LABELLED)
    return facts.bash(spark, sf).select("row_id", plain("cmd").alias("cmd"), labelled("out").alias("out"))


@query()
def secret_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that redaction changes, with the first changed line."""
    line = redaction.secret_line_udf()
    return table(spark, sf, "documents").select("doc_id", line("text").alias("line")).where("line is not null")


@query()
def normalize_command(spark: SparkSession, sf: str) -> DataFrame:
    """Family, program, masked text, chain length and background of each command as typed."""
    f = shell.normalize_udf()
    return facts.bash(spark, sf).where("cmd is not null").select("row_id", f("cmd").alias("n")).select("row_id", "n.*")


@query(with_facts("b", "SELECT row_id, upper(bin) AS bin, regexp_replace(family, '\\d+$', '') AS stem, coalesce(nullif(trim(\"desc\"), ''), 'none') AS note FROM b"))
def small_text(spark: SparkSession, sf: str) -> DataFrame:
    b = facts.bash(spark, sf)
    return b.select("row_id", F.upper("bin").alias("bin"), T.group_of(F.col("family")).alias("stem"), T.or_none(F.col("desc")).alias("note"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(substring(text, 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents WHERE text IS NOT NULL")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 characters of each document, as a preview shows them."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.escape_html(F.substring("text", 1, 200)).alias("html"))


@query("SELECT doc_id, sha1(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS sha FROM documents WHERE text IS NOT NULL")
def html_escape_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Each whole document escaped, as its digest."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha1(T.escape_html(F.col("text")).cast("binary")).alias("sha"))


QUERIES, ORACLES = query.queries, query.oracles
