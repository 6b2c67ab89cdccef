"""Where time, tokens and errors went, over all sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import numbers as N
from stratalog.functions import text as T
from stratalog.operators import ranking as R
from stratalog.operators import sequences as S
from stratalog.plans.catalogue import Catalogue
from stratalog.sources import facts
from stratalog.sources.facts import SQL_MS, sql_half_up, with_facts

query = Catalogue()
TOP = 25
TOKENS = ["inTokens", "outTokens", "cacheReadTokens", "cacheCreateTokens"]
KINDS = ["main", "subagent", "workflow-agent"]
WEB = ["WebFetch", "WebSearch"]

_SUMS = ", ".join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in TOKENS)
_ORDERED = lambda metric, tie, cols: f"SELECT {cols}, (SELECT count(*) FROM g) AS total FROM g ORDER BY {metric} DESC NULLS LAST, {tie} ASC NULLS FIRST LIMIT {TOP}"


def _sums() -> list:
    return [F.sum(c).alias(c) for c in TOKENS]


def _kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KINDS], "kind string")


@query(with_facts("s", """SELECT count(*) AS files, count(*) FILTER (kind = 'main') AS main, count(*) FILTER (kind = 'subagent') AS subagent, count(*) FILTER (kind = 'workflow-agent') AS workflow_agent, count(DISTINCT proj) AS projects, min(start) AS from_t, max("end") AS to_t FROM s"""))
def window_section(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in KINDS]
    return facts.sessions(spark, sf, "kind", "proj", "start", "end").agg(F.count("*").alias("files"), *kinds, F.countDistinct("proj").alias("projects"), F.min("start").alias("from_t"), F.max("end").alias("to_t"))


@query(with_facts("s", f"SELECT {_SUMS} FROM s"))
def tokens_totals(spark: SparkSession, sf: str) -> DataFrame:
    return facts.sessions(spark, sf, *TOKENS).agg(*_sums())


def _by_model(sessions: DataFrame) -> DataFrame:
    """A session's tokens go to its models in proportion to their calls; sessions without models to (unknown)."""
    calls = F.aggregate(F.map_values("models"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    has = F.col("models").isNotNull() & (F.size("models") > 0)
    pairs = F.when(has, F.transform(F.map_entries("models"), lambda e: F.struct(e.key.alias("model"), e.value.alias("n")))).otherwise(F.array(F.struct(F.lit("(unknown)").alias("model"), F.lit(1).cast("bigint").alias("n"))))
    spread = sessions.select(*TOKENS, F.when(has, calls).otherwise(1).alias("calls"), F.explode(pairs).alias("p"))
    # Shares are kept in millionths of a token, so sums don't depend on their order.
    micro = [F.round(F.col(c) * 1e6 * N.safe_div(F.col("p.n"), F.col("calls"))).cast("bigint").alias(c) for c in TOKENS]
    return spread.select(F.col("p.model").alias("model"), *micro).groupBy("model").agg(*[N.half_up(F.sum(c) / 1e6).cast("bigint").alias(c) for c in TOKENS])


_MODEL = ", ".join(f'CAST({sql_half_up(f"sum(CAST(round({chr(34)}{c}{chr(34)} * 1e6 * (n / calls)) AS BIGINT)) / 1e6")} AS BIGINT) AS "{c}"' for c in TOKENS)


@query(with_facts("s", f""", p AS (
    SELECT *, unnest(CASE WHEN models IS NULL OR cardinality(models) = 0 THEN ['(unknown)'] ELSE map_keys(models) END) AS model,
      CAST(unnest(CASE WHEN models IS NULL OR cardinality(models) = 0 THEN [1] ELSE map_values(models) END) AS DOUBLE) AS n,
      CASE WHEN models IS NULL OR cardinality(models) = 0 THEN 1 ELSE list_sum(map_values(models)) END AS calls FROM s)
  SELECT model, {_MODEL} FROM p GROUP BY model"""))
def tokens_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return _by_model(facts.sessions(spark, sf, "models", *TOKENS))


@query(with_facts("s", "SELECT k.kind, " + ", ".join(f'CAST(coalesce(sum("{c}"), 0) AS BIGINT) AS "{c}"' for c in TOKENS) + " FROM (SELECT unnest(['main', 'subagent', 'workflow-agent']) AS kind) k LEFT JOIN s USING (kind) GROUP BY k.kind"))
def tokens_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    sums = facts.sessions(spark, sf, "kind", *TOKENS).groupBy("kind").agg(*_sums())
    return _kinds(spark).join(sums, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in TOKENS])


_GRAND = " + ".join(f'coalesce("{c}", 0)' for c in TOKENS)


@query(with_facts("s", f', g AS (SELECT proj, {_SUMS}, count(*) AS sessions, CAST(sum({_GRAND}) AS BIGINT) AS grand FROM s GROUP BY proj) {_ORDERED("grand", "proj", "proj, sessions, grand, " + ", ".join(chr(34) + c + chr(34) for c in TOKENS))}'))
def tokens_by_project(spark: SparkSession, sf: str) -> DataFrame:
    grand = sum((F.coalesce(c, F.lit(0)) for c in TOKENS[1:]), F.coalesce(TOKENS[0], F.lit(0)))
    g = facts.sessions(spark, sf, "proj", *TOKENS).groupBy("proj").agg(*_sums(), F.count("*").alias("sessions"), F.sum(grand).alias("grand"))
    return R.ranking(g, "grand", "proj", TOP)


def _wall(df: DataFrame, by: str) -> DataFrame:
    secs = df.withColumn("ms", facts.msecs()).withColumn("err", F.coalesce("err", F.lit(False)).cast("int"))
    return secs.groupBy(by).agg(
        F.count("*").alias("calls"),
        N.half_up(F.sum("ms") / 1000.0, 1).alias("total_sec"),
        N.half_up(F.expr("percentile(ms, 0.5)") / 1000.0, 2).alias("median_sec"),
        N.half_up(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)") / 1000.0, 2).alias("p95_sec"),
        N.half_up(F.sum("err") / F.count("*"), 4).alias("err_rate"),
    )


_WALL = f"count(*) AS calls, {sql_half_up(f'sum({SQL_MS}) / 1000.0', 1)} AS total_sec, {sql_half_up(f'quantile_cont({SQL_MS}, 0.5) / 1000.0', 2)} AS median_sec, {sql_half_up(f'quantile_disc({SQL_MS}, 0.95) / 1000.0', 2)} AS p95_sec, {sql_half_up('sum(coalesce(err, false)::INT) / count(*)', 4)} AS err_rate"


@query(with_facts("t", f', g AS (SELECT tool, {_WALL} FROM t GROUP BY tool) {_ORDERED("total_sec", "tool", "*")}'))
def wall_by_tool(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking(_wall(facts.tools(spark, sf), "tool"), "total_sec", "tool", TOP)


@query(with_facts("t", f', g AS (SELECT proj, count(*) AS calls, {sql_half_up(f"sum({SQL_MS}) / 1000.0", 1)} AS total_sec FROM t GROUP BY proj) {_ORDERED("total_sec", "proj", "*")}'))
def wall_by_project(spark: SparkSession, sf: str) -> DataFrame:
    g = facts.tools(spark, sf).groupBy("proj").agg(F.count("*").alias("calls"), N.half_up(F.sum(facts.msecs()) / 1000.0, 1).alias("total_sec"))
    return R.ranking(g, "total_sec", "proj", TOP)


def _families(spark: SparkSession, sf: str) -> DataFrame:
    bash = facts.bash(spark, sf)
    bins = bash.groupBy("family", "bin").agg(F.count("*").alias("n")).groupBy("family").agg(R.mode("bin", "n").alias("bin"))
    return _wall(bash, "family").join(bins, "family", "left")


_FAMILY = with_facts("b", f", g AS (SELECT family, {_WALL} FROM b WHERE family IS NOT NULL GROUP BY family), n AS (SELECT family, bin, count(*) AS n FROM b GROUP BY ALL), o AS (SELECT family, arg_min(bin, (-n, bin)) AS bin FROM n GROUP BY family)")
_FAMILY_ORDER = "SELECT g.*, o.bin, (SELECT count(*) FROM g) AS total FROM g LEFT JOIN o USING (family) ORDER BY {} DESC, family LIMIT " + str(TOP)


@query(_FAMILY + " " + _FAMILY_ORDER.format("total_sec"))
def cmd_by_total_sec(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking(_families(spark, sf).where("family is not null"), "total_sec", "family", TOP)


@query(_FAMILY + " " + _FAMILY_ORDER.format("calls"))
def cmd_by_count(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking(_families(spark, sf).where("family is not null"), "calls", "family", TOP)


_WS = r"trim(regexp_replace(cmd, '\s+', ' ', 'g'))"


@query(with_facts("b", f""", c AS (SELECT sid, {_WS} AS cmd, {SQL_MS} AS ms, row_number() OVER (PARTITION BY sid, {_WS} ORDER BY coalesce(t, 0), row_id) AS k FROM b WHERE cmd IS NOT NULL),
  g AS (SELECT cmd, count(*) AS repeats, count(DISTINCT sid) AS sessions, {sql_half_up("sum(ms) / 1000.0", 1)} AS secs FROM c WHERE k > 1 GROUP BY cmd) {_ORDERED("repeats", "cmd", "*")}"""))
def cmd_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Repetitions of a command within a session: how often, in how many sessions, and the seconds after each first run."""
    rows = facts.bash(spark, sf).where("cmd is not null").select("sid", T.collapse(F.col("cmd")).alias("cmd"), F.coalesce("t", F.lit(0)).alias("t"), "row_id", facts.msecs().alias("ms"))
    # What came after the first is everything less the first: an aggregate, so a hot (session, command) combines map-side.
    per = rows.groupBy("sid", "cmd").agg((F.count("*") - 1).alias("again"), (F.sum("ms") - F.min_by("ms", F.struct("t", "row_id"))).alias("ms")).where("again > 0")
    g = per.groupBy("cmd").agg(F.sum("again").alias("repeats"), F.count("*").alias("sessions"), N.half_up(F.sum("ms") / 1000.0, 1).alias("secs"))
    return R.ranking(g, "repeats", "cmd", TOP)


@query(with_facts("b", f""", o AS (SELECT sid, bin, t, family, {SQL_MS} AS ms, row_number() OVER (PARTITION BY sid, bin ORDER BY t, row_id) AS k FROM b WHERE t IS NOT NULL),
  w AS (WITH RECURSIVE w AS (SELECT sid, bin, k, t, t AS opener, 0 AS burst, family, ms FROM o WHERE k = 1
    UNION ALL SELECT o.sid, o.bin, o.k, o.t, CASE WHEN o.t - w.opener > 600 THEN o.t ELSE w.opener END, CASE WHEN o.t - w.opener > 600 THEN w.burst + 1 ELSE w.burst END, o.family, o.ms
    FROM w JOIN o ON o.sid IS NOT DISTINCT FROM w.sid AND o.bin IS NOT DISTINCT FROM w.bin AND o.k = w.k + 1) SELECT * FROM w),
  x AS (SELECT sid, bin, burst, count(DISTINCT coalesce(family, '')) AS families, sum(ms) AS ms FROM w GROUP BY ALL HAVING families >= 4),
  g AS (SELECT bin, CAST(sum(families) AS BIGINT) AS variants, count(*) AS bursts, count(DISTINCT sid) AS sessions, {sql_half_up("sum(ms) / 1000.0", 1)} AS secs FROM x GROUP BY bin) {_ORDERED("variants", "bin", "*")}"""))
def cmd_flag_flailing(spark: SparkSession, sf: str) -> DataFrame:
    """Programs called in bursts of many different ways."""
    rows = facts.bash(spark, sf).select("sid", "bin", "t", F.col("row_id").alias("seq"), F.coalesce("family", F.lit("")).alias("family"), "cmd", (facts.msecs() * 1.0).alias("secs"))
    wild = S.bursts(rows).where(F.size("families") >= S.BURST_FAMILIES)
    g = wild.groupBy("bin").agg(F.sum(F.size("families")).alias("variants"), F.count("*").alias("bursts"), F.countDistinct("sid").alias("sessions"), N.half_up(F.sum("secs") / 1000.0, 1).alias("secs"))
    return R.ranking(g, "variants", "bin", TOP)


@query(with_facts("b", f""", c AS (SELECT sid, {_WS} AS cmd, coalesce(family, '') AS family, coalesce(err, false) AS err, t, row_id FROM b WHERE t IS NOT NULL AND cmd IS NOT NULL),
  i AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sid, cmd ORDER BY t, row_id) <= 300 THEN 0 ELSE 1 END AS fresh FROM c),
  j AS (SELECT *, sum(fresh) OVER (PARTITION BY sid, cmd ORDER BY t, row_id) AS island FROM i),
  k AS (SELECT *, sum(err::INT) OVER (PARTITION BY sid, cmd, island ORDER BY t, row_id) AS seen FROM j),
  l AS (SELECT sid, cmd, island, count(*) - 1 AS retries, arg_min(family, (t, row_id)) AS family FROM k WHERE seen > 0 GROUP BY ALL HAVING count(*) > 1),
  g AS (SELECT family, count(*) AS loops, {sql_half_up("quantile_cont(retries, 0.5)", 2)} AS median_retries, count(DISTINCT sid) AS sessions, arg_min(cmd, (length(cmd), cmd)) AS sample FROM l GROUP BY family) {_ORDERED("loops", "family", "*")}"""))
def err_retry_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Failed commands run again unchanged."""
    rows = facts.bash(spark, sf).where("cmd is not null").select("sid", "t", F.col("row_id").alias("seq"), T.collapse(F.col("cmd")).alias("cmd"), F.coalesce("family", F.lit("")).alias("family"), F.coalesce("err", F.lit(False)).alias("err"))
    g = S.retry_chains(rows).groupBy("family").agg(F.count("*").alias("loops"), N.half_up(F.expr("percentile(retries, 0.5)"), 2).alias("median_retries"), F.countDistinct("sid").alias("sessions"), R.shortest("cmd").alias("sample"))
    return R.ranking(g, "loops", "family", TOP)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Error texts with where they came from: those of all failed calls, and failed shell calls that printed something unless these are among them."""
    bash = facts.bash(spark, sf).where("err and length(out) > 0").select("sid", "proj", F.lit("Bash").alias("tool"), F.col("out").alias("msg"))
    errors = facts.errors(spark, sf)
    if errors is None:
        return bash
    told = errors.select("sid", "proj", "tool", "msg")
    return told.unionByName(bash) if told.where("tool = 'Bash'").isEmpty() else told


@query(with_facts("b", "SELECT sid, proj, 'Bash' AS tool, count(*) AS n FROM b WHERE err AND length(out) > 0 GROUP BY ALL"))
def err_observations(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf).groupBy("sid", "proj", "tool").agg(F.count("*").alias("n"))


_SIG = "array_to_string(list_filter(string_split(out, chr(10)), lambda x: trim(x) <> '')[1:2], ' ')"
for _p, _m in T.SIGNATURE_MASKS:
    _SIG = f"regexp_replace({_SIG}, '{_p.replace(chr(39), chr(39) * 2)}', '{_m}', 'g')"
_SIG = rf"substring(trim(regexp_replace({_SIG}, '\s+', ' ', 'g')), 1, 200)"
_MSG = r"trim(regexp_replace(out, '\s+', ' ', 'g'))"


@query(with_facts("b", f""", o AS (SELECT sid, proj, {_SIG} AS sig, {_MSG} AS msg FROM b WHERE err AND length(out) > 0),
  g AS (SELECT sig, count(*) AS n, count(DISTINCT sid) AS sessions, array_to_string(list_sort(list_distinct(list(proj)))[1:5], ',') AS projects, substring(arg_min(msg, (length(msg), msg)), 1, 240) AS sample, 'Bash' AS top_tool FROM o GROUP BY sig) {_ORDERED("n", "sig", "*")}"""))
def err_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of the same signature."""
    return R.ranking(clusters(observations(spark, sf)), "n", "sig", TOP)


def clusters(rows: DataFrame) -> DataFrame:
    """Observations (sid, proj, tool, msg) by signature: how many, in how many sessions, first projects, shortest text, most frequent tool (ties: by name)."""
    o = rows.select("sid", "proj", "tool", T.error_signature(F.col("msg")).alias("sig"), T.collapse(F.col("msg")).alias("msg"))
    g = o.groupBy("sig").agg(
        F.count("*").alias("n"), F.countDistinct("sid").alias("sessions"), F.array_join(F.slice(F.array_sort(F.collect_set("proj")), 1, 5), ",").alias("projects"), F.substring(R.shortest("msg"), 1, 240).alias("sample")
    )
    top = o.groupBy("sig", "tool").agg(F.count("*").alias("k")).groupBy("sig").agg(R.mode("tool", "k").alias("top_tool"))
    return g.join(top, g["sig"].eqNullSafe(top["sig"])).drop(top["sig"])


#: How a shell or a runtime names a program it can't find, and what a refused call was refused on.
MISSING = [
    r"command not found:\s*([A-Za-z0-9_.+-]+)", r"([A-Za-z0-9_.+-]+):\s*command not found", r"'([^']+)' is not recognized as an internal or external command",
    r"spawn\s+([A-Za-z0-9_.+\-/\\]+)\s+ENOENT", r"ENOENT[^\n]*?['\"]([^'\"]+)['\"]", r"([A-Za-z0-9_.+-]+):\s*not found", r"No such file or directory:\s*['\"]?([A-Za-z0-9_.+\-/\\]+)",
]
REFUSED = [r"(?:EACCES|EPERM)[^\n]*?['\"]([^'\"]+)['\"]", r"[Pp]ermission denied[^\n]*?['\"]([^'\"]+)['\"]", r"([^\s:'\"]+):\s*[Pp]ermission denied"]
ERRNO = ["EACCES", "EPERM", "ENOENT", "EISDIR", "EROFS"]
DENIED = r"(?i)permission denied|EACCES|EPERM|operation not permitted|not permitted to|requires approval"


def _targets(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("sessions"), F.substring(R.shortest("msg"), 1, 200).alias("sample"))
    return R.ranking(g, "n", "target", TOP)


def _sql_capture(patterns: list[str], final: str) -> str:
    skip = ", ".join(f"'{e}'" for e in ERRNO)
    tries = []
    for p in patterns:
        x = f"trim(regexp_extract(out, '{p.replace(chr(39), chr(39) * 2)}', 1))"
        tries.append(f"CASE WHEN {x} <> '' AND {x} NOT IN ({skip}) THEN {x} END")
    return f"coalesce({', '.join(tries)}, {final})"


_TARGET = f"g AS (SELECT target, count(*) AS n, count(DISTINCT sid) AS sessions, substring(arg_min(msg, (length(msg), msg)), 1, 200) AS sample FROM o WHERE target IS NOT NULL GROUP BY target) {_ORDERED('n', 'target', '*')}"


@query(with_facts("b", f", o AS (SELECT sid, {_MSG} AS msg, {_sql_capture(MISSING, 'NULL')} AS target FROM b WHERE err AND length(out) > 0), {_TARGET}"))
def err_missing_bin(spark: SparkSession, sf: str) -> DataFrame:
    """Programs and files that weren't there."""
    o = observations(spark, sf).select("sid", T.first_capture(F.col("msg"), MISSING, ERRNO).alias("target"), T.collapse(F.col("msg")).alias("msg"))
    return _targets(o.where("target is not null"))


@query(with_facts("b", f", o AS (SELECT sid, {_MSG} AS msg, {_sql_capture(REFUSED, repr('Bash'))} AS target FROM b WHERE err AND length(out) > 0 AND regexp_matches(out, '{DENIED}')), {_TARGET}"))
def err_denied(spark: SparkSession, sf: str) -> DataFrame:
    """What calls were refused on; the tool's name where the text doesn't say."""
    o = observations(spark, sf).where(F.col("msg").rlike(DENIED))
    return _targets(o.select("sid", F.coalesce(T.first_capture(F.col("msg"), REFUSED, ERRNO), "tool").alias("target"), T.collapse(F.col("msg")).alias("msg")))


@query(with_facts("s", f', g AS (SELECT sid, proj, kind, "maxCtx" FROM s) {_ORDERED(chr(34) + "maxCtx" + chr(34), "sid", "*")}'))
def ctx_top_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking(facts.sessions(spark, sf, "proj", "kind", "maxCtx"), "maxCtx", "sid", TOP)


@query(with_facts("t", f', g AS (SELECT row_id, sid, tool, "outChars", CAST(floor("outChars" / 4 + 0.5) AS BIGINT) AS tokens FROM t WHERE "outChars" > 0) {_ORDERED(chr(34) + "outChars" + chr(34), "row_id", "*")}'))
def ctx_big_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.tools(spark, sf).where("outChars > 0").select("row_id", "sid", "tool", "outChars", F.floor(F.col("outChars") / 4 + 0.5).alias("tokens"))
    return R.ranking(rows, "outChars", "row_id", TOP)


@query(with_facts("t", 'SELECT tool, quantile_disc("outChars", 0.95) AS p95_chars FROM t GROUP BY tool'))
def ctx_p95_chars(spark: SparkSession, sf: str) -> DataFrame:
    return facts.tools(spark, sf).groupBy("tool").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY outChars)").cast("bigint").alias("p95_chars"))


@query(with_facts("t", f""", r AS (SELECT sid, arg, coalesce("outChars", 0) AS ch, row_number() OVER (PARTITION BY sid, arg ORDER BY row_id) AS k FROM t WHERE tool = 'Read' AND arg <> ''),
  g AS (SELECT arg, count(*) AS extra_reads, count(DISTINCT sid) AS sessions, CAST(floor(sum(ch) / 4 + 0.5) AS BIGINT) AS tokens FROM r WHERE k > 1 GROUP BY arg) {_ORDERED("extra_reads", "arg", "*")}"""))
def ctx_rereads(spark: SparkSession, sf: str) -> DataFrame:
    """Files read again in the same session, in order of the log."""
    rows = facts.tools(spark, sf).where("tool = 'Read' and arg <> ''").select("sid", "arg", "row_id", F.coalesce("outChars", F.lit(0)).alias("ch"))
    per = rows.groupBy("sid", "arg").agg((F.count("*") - 1).alias("again"), (F.sum("ch") - F.min_by("ch", "row_id")).alias("ch")).where("again > 0")
    g = per.groupBy("arg").agg(F.sum("again").alias("extra_reads"), F.count("*").alias("sessions"), F.floor(F.sum("ch") / 4 + 0.5).alias("tokens"))
    return R.ranking(g, "extra_reads", "arg", TOP)


@query(with_facts("s", f"""SELECT k.kind, {sql_half_up('coalesce(sum("cacheCreateTokens") / nullif(coalesce(sum("cacheCreateTokens"), 0) + coalesce(sum("cacheReadTokens"), 0), 0), 0)', 4)} AS write_ratio
  FROM (SELECT unnest(['main', 'subagent', 'workflow-agent']) AS kind) k LEFT JOIN s USING (kind) GROUP BY k.kind"""))
def ctx_cache_ratio(spark: SparkSession, sf: str) -> DataFrame:
    sums = facts.sessions(spark, sf, "kind", "cacheCreateTokens", "cacheReadTokens").groupBy("kind").agg(F.sum("cacheCreateTokens").alias("w"), F.sum("cacheReadTokens").alias("r"))
    ratio = N.safe_div(F.col("w"), F.coalesce("w", F.lit(0)) + F.coalesce("r", F.lit(0)))
    return _kinds(spark).join(sums, "kind", "left").select("kind", N.half_up(ratio, 4).alias("write_ratio"))


_WEBROWS = "w AS (SELECT t.*, s.run FROM t LEFT JOIN s USING (sid) WHERE tool IN ('WebFetch', 'WebSearch'))"


def _web(spark: SparkSession, sf: str) -> DataFrame:
    runs = facts.sessions(spark, sf, "run")
    return facts.tools(spark, sf).where(F.col("tool").isin(WEB)).join(runs, "sid", "left")


@query(with_facts("ts", f""", {_WEBROWS} SELECT k.tool, count(w.row_id) AS calls, {sql_half_up("coalesce(sum(" + SQL_MS + "), 0) / 1000.0", 1)} AS secs, CAST(coalesce(sum("outChars"), 0) AS BIGINT) AS chars
  FROM (SELECT unnest(['WebFetch', 'WebSearch']) AS tool) k LEFT JOIN w USING (tool) GROUP BY k.tool"""))
def web_by_tool(spark: SparkSession, sf: str) -> DataFrame:
    g = _web(spark, sf).groupBy("tool").agg(F.count("*").alias("calls"), F.sum(facts.msecs()).alias("ms"), F.sum("outChars").alias("chars"))
    both = spark.createDataFrame([(w,) for w in WEB], "tool string").join(g, "tool", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("tool", zero("calls").alias("calls"), N.half_up(zero("ms") / 1000.0, 1).alias("secs"), zero("chars").alias("chars"))


@query(with_facts("ts", f""", {_WEBROWS}, g AS (SELECT tool || ' ' || arg AS what, count(*) AS n, CAST(sum("outChars") AS BIGINT) AS chars, count(DISTINCT sid) AS sessions,
    count(DISTINCT coalesce(run, '')) = 1 AND max(coalesce(run, '')) <> '' AS same_run FROM w WHERE arg <> '' GROUP BY tool, arg HAVING count(*) >= 2) {_ORDERED("n", "what", "*")}"""))
def web_repeats(spark: SparkSession, sf: str) -> DataFrame:
    run = F.coalesce("run", F.lit(""))
    g = _web(spark, sf).where("arg <> ''").groupBy("tool", "arg").agg(
        F.count("*").alias("n"), F.sum("outChars").alias("chars"), F.countDistinct("sid").alias("sessions"), ((F.countDistinct(run) == 1) & (F.max(run) != "")).alias("same_run")
    )
    return R.ranking(g.where("n >= 2").select(F.concat_ws(" ", "tool", "arg").alias("what"), "n", "chars", "sessions", "same_run"), "n", "what", TOP)


@query(with_facts("ts", f""", {_WEBROWS}, g AS (SELECT tool, arg, count(*) AS n FROM w WHERE arg <> '' GROUP BY ALL)
  SELECT {sql_half_up("coalesce((SELECT sum(n - 1) FROM g) / nullif((SELECT count(*) FROM w), 0), 0)", 4)} AS repeat_rate"""))
def web_repeat_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated calls over all web calls."""
    g = _web(spark, sf).groupBy("tool", "arg").agg(F.count("*").alias("n"))
    again = F.sum(F.when(F.col("arg") != "", F.col("n") - 1).otherwise(0))
    return g.agg(N.half_up(N.safe_div(again, F.sum("n")), 4).alias("repeat_rate"))


@query(with_facts("ts", f""", {_WEBROWS}, g AS (SELECT run, count(*) AS calls, CAST(sum("outChars") AS BIGINT) AS chars, count(DISTINCT sid) AS agents FROM w WHERE run <> '' GROUP BY run) {_ORDERED("calls", "run", "*")}"""))
def web_by_run(spark: SparkSession, sf: str) -> DataFrame:
    g = _web(spark, sf).where("run <> ''").groupBy("run").agg(F.count("*").alias("calls"), F.sum("outChars").alias("chars"), F.countDistinct("sid").alias("agents"))
    return R.ranking(g, "calls", "run", TOP)


@query(with_facts("s", f""", w AS (SELECT * FROM s WHERE run <> ''), n AS (SELECT run, proj, count(*) AS n FROM w WHERE proj IS NOT NULL GROUP BY ALL), o AS (SELECT run, arg_min(proj, (-n, proj)) AS proj FROM n GROUP BY run),
  g AS (SELECT run, count(*) AS agents, {_SUMS}, {sql_half_up('coalesce(quantile_cont("firstTurnCacheCreate", 0.5), 0)', 2)} AS median_first_write FROM w GROUP BY run)
  SELECT g.*, o.proj, (SELECT count(*) FROM g) AS total FROM g LEFT JOIN o USING (run) ORDER BY "cacheReadTokens" DESC NULLS LAST, run LIMIT {TOP}"""))
def fan_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Workflow runs with their agents, totals, and the median of what agents wrote to the cache first."""
    w = facts.sessions(spark, sf, "run", "proj", "firstTurnCacheCreate", *TOKENS).where("run <> ''")
    proj = w.where("proj is not null").groupBy("run", "proj").agg(F.count("*").alias("n")).groupBy("run").agg(R.mode("proj", "n").alias("proj"))
    g = w.groupBy("run").agg(F.count("*").alias("agents"), *_sums(), N.half_up(F.coalesce(F.expr("percentile(firstTurnCacheCreate, 0.5)"), F.lit(0.0)), 2).alias("median_first_write"))
    return R.ranking(g.join(proj, "run", "left"), "cacheReadTokens", "run", TOP)


@query(with_facts("s", f""", y AS (SELECT sid, "cacheReadTokens", "outTokens" / "cacheReadTokens" AS yield FROM s WHERE kind <> 'main' AND "cacheReadTokens" > 0 AND "outTokens" IS NOT NULL),
  g AS (SELECT sid, "cacheReadTokens", {sql_half_up("yield", 6)} AS yield FROM y WHERE yield <= (SELECT quantile_disc(yield, 0.1) FROM y)) {_ORDERED(chr(34) + "cacheReadTokens" + chr(34), "sid", "*")}"""))
def fan_low_yield(spark: SparkSession, sf: str) -> DataFrame:
    """Agents among the tenth that wrote least for what they read."""
    y = facts.sessions(spark, sf, "kind", "cacheReadTokens", "outTokens").where("kind <> 'main' and cacheReadTokens > 0 and outTokens is not null").select("sid", "cacheReadTokens", (F.col("outTokens") / F.col("cacheReadTokens")).alias("yield"))
    line = y.agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY yield)").alias("line"))  # one row
    low = y.crossJoin(F.broadcast(line)).where("yield <= line")
    return R.ranking(low.select("sid", "cacheReadTokens", N.half_up(F.col("yield"), 6).alias("yield")), "cacheReadTokens", "sid", TOP)


@query(with_facts("s", """SELECT count(*) FILTER (kind <> 'main' AND "firstTurnCacheCreate" > 0) AS agents_with_first_write, CAST(coalesce(sum("firstTurnCacheCreate") FILTER (kind = 'workflow-agent'), 0) AS BIGINT) AS workflow_first_write FROM s"""))
def fan_scalars(spark: SparkSession, sf: str) -> DataFrame:
    first = F.col("firstTurnCacheCreate")
    return facts.sessions(spark, sf, "kind", "firstTurnCacheCreate").agg(
        F.count_if((F.col("kind") != "main") & (first > 0)).alias("agents_with_first_write"),
        F.coalesce(F.sum(F.when(F.col("kind") == "workflow-agent", first)), F.lit(0)).alias("workflow_first_write"),
    )


_PROJ = f""", n AS (SELECT proj, cwd, count(*) AS n FROM s WHERE cwd IS NOT NULL GROUP BY ALL), o AS (SELECT proj, arg_min(cwd, (-n, cwd)) AS cwd FROM n GROUP BY proj),
  x AS (SELECT proj, {sql_half_up("sum(" + SQL_MS + ") / 1000.0", 1)} AS bash_secs, count(*) AS bash_calls FROM b GROUP BY proj),
  g AS (SELECT proj, count(*) AS sessions, CAST(sum({_GRAND}) AS BIGINT) AS grand FROM s WHERE proj IS NOT NULL GROUP BY proj)
  SELECT g.*, o.cwd, coalesce(x.bash_secs, 0) AS bash_secs, coalesce(x.bash_calls, 0) AS bash_calls, (SELECT count(*) FROM g) AS total FROM g LEFT JOIN o USING (proj) LEFT JOIN x USING (proj) ORDER BY grand DESC, proj LIMIT {TOP}"""


@query(with_facts("sb", _PROJ))
def proj_report(spark: SparkSession, sf: str) -> DataFrame:
    """Projects by tokens, with their usual folder and their shell seconds."""
    s = facts.sessions(spark, sf, "proj", "cwd", *TOKENS).where("proj is not null")
    cwd = s.where("cwd is not null").groupBy("proj", "cwd").agg(F.count("*").alias("n")).groupBy("proj").agg(R.mode("cwd", "n").alias("cwd"))
    shell = facts.bash(spark, sf).groupBy("proj").agg(N.half_up(F.sum(facts.msecs()) / 1000.0, 1).alias("bash_secs"), F.count("*").alias("bash_calls"))
    grand = sum((F.coalesce(c, F.lit(0)) for c in TOKENS[1:]), F.coalesce(TOKENS[0], F.lit(0)))
    g = s.groupBy("proj").agg(F.count("*").alias("sessions"), F.sum(grand).alias("grand"))
    return R.ranking(g.join(cwd, "proj", "left").join(shell, "proj", "left").fillna(0, ["bash_secs", "bash_calls"]), "grand", "proj", TOP)


@query(with_facts("b", f""", g AS (SELECT proj, family, count(*) AS calls, sum({SQL_MS}) AS ms FROM b WHERE proj IS NOT NULL AND family IS NOT NULL GROUP BY ALL)
  SELECT proj, family, calls, CAST(ms AS BIGINT) AS ms, row_number() OVER (PARTITION BY proj ORDER BY ms DESC, family) AS rank FROM g QUALIFY rank <= 5"""))
def proj_top_commands(spark: SparkSession, sf: str) -> DataFrame:
    g = facts.bash(spark, sf).where("proj is not null and family is not null").groupBy("proj", "family").agg(F.count("*").alias("calls"), F.sum(facts.msecs()).alias("ms"))
    return R.top_per_group(g, ["proj"], [F.col("ms").desc(), F.col("family").asc()], 5)


QUERIES, ORACLES = query.queries, query.oracles
