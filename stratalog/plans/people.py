"""What people asked for, corrected, and asked for again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import text as T
from stratalog.operators import ranking as R
from stratalog.plans.catalogue import Catalogue
from stratalog.plans.fleet import TOP
from stratalog.sources import facts
from stratalog.sources.facts import with_facts

query = Catalogue()

#: Themes of corrections, with the patterns of each.
THEMES = {
    "scope creep": [
        r"\bi (?:only|just) (?:asked|said)\b", r"\bi (?:only|just) (?:wanted|needed) (?:the|this|that|it|you to)\b", r"\bdid ?n[o']t ask (?:you )?(?:for|to)\b", r"\bthat[' ]?s? (?:not|nothing) what i asked\b",
        r"\bout of scope\b", r"\bstop (?:adding|creating|writing|making|building|refactor)", r"\bdo ?n[o']t (?:add|create|touch|change|refactor|rewrite|modify)\b",
        r"\bwhy did you (?:also|even|change|add|create|touch)\b", r"\bstick to (?:the|what)\b", r"\b(?:only|just) (?:the|this|that) (?:one|file|change|part)\b", r"\bnothing else\b", r"\btoo (?:much|far|many changes)\b",
    ],
    "wrong tool": [
        r"\buse (?:the )?(?:rg|ripgrep|executor|agent-browser|bun|pnpm|the [a-z-]+ skill|the [a-z-]+ cli|mcp)\b", r"\bdo ?n[o']t use\b", r"\bwrong (?:tool|command|script|approach|way)\b",
        r"\b(?:instead of|rather than) (?:using |running )?(?:npm|yarn|curl|grep|find|bash|the )", r"\bnot (?:npm|yarn|curl|grep|find)\b", r"\bwhy (?:are you|did you) (?:using|use) \b",
        r"\bthere ?[' ]?s (?:a|an) (?:skill|script|command|tool) for (?:that|this)\b", r"\brun it (?:with|through)\b",
    ],
    "too verbose": [
        r"\btoo (?:long|verbose|wordy|much text)\b", r"\bbe (?:more )?(?:concise|brief|short|terse)\b", r"\b(?:make it |be )?shorter\b", r"\bless (?:text|words|prose|output)\b", r"\bstop explaining\b",
        r"\bno need to (?:explain|summar)", r"\btl ?;? ?dr\b", r"\bcut (?:it|this|that) down\b", r"\bfewer words\b", r"\bwithout the (?:preamble|summary|explanation)\b",
    ],
    "ignored an existing rule": [
        r"\b(?:claude\.md|agents\.md|the skill|the rules?|my rules?|the instructions)\b[^.]{0,60}\b(?:says?|said|ignor|forgot|violat|not follow|did ?n[o']t follow)\b",
        r"\b(?:you )?(?:ignored|forgot|missed|skipped) (?:the|my|our) (?:rule|instruction|skill|convention|claude\.md|agents\.md)", r"\bas i (?:said|told you|asked|already said)\b",
        r"\b(?:i )?(?:told|asked) you (?:this|that|already|before|again)\b", r"\bread the (?:skill|rules?|claude\.md|agents\.md|instructions|docs)\b", r"\bfollow the (?:rules?|instructions|skill|convention|style)\b",
        r"\byou (?:keep|always) (?:doing|adding|writing|ignoring)\b", r"\bhow many times\b",
    ],
    "wrong assumption": [
        r"\b(?:that|this|it)[' ]?s (?:wrong|incorrect|not right|false|not true)\b", r"\byou[' ]?re (?:wrong|guessing|assuming|making that up)\b", r"\bdoes ?n[o']t exist\b",
        r"\bno such (?:file|function|field|method|command|option)\b", r"\byou (?:assumed|guessed|invented|made (?:that|it) up|hallucinat)", r"\bhallucinat", r"\bcheck (?:first|the (?:code|docs|file|source|actual))\b",
        r"\bwhere did you get (?:that|this)\b", r"\bnot how (?:it|this|that) works\b",
    ],
    "redo or revert": [
        r"(?:^|[,.!?;:]\s*|\b(?:and|then|now|please|just|so|you|we)\s+(?:should\s+|need to\s+)?)(?:revert|roll ?back)\b", r"\bundo (?:that|this|it|everything|your)\b", r"\bstart (?:over|again from)\b",
        r"\bredo (?:it|that|this)\b", r"\btry again\b", r"\bgit (?:checkout|reset|restore)\b", r"\b(?:remove|delete|drop) (?:what|everything|all) you (?:did|added|wrote|created)\b", r"\bthrow (?:it|that) away\b",
        r"\bnot what i (?:wanted|asked|meant)\b",
    ],
}
#: Markers of turns that a harness wrote.
MARKERS = ["<system-reminder>", "<task-notification>", "<command-name>", "<command-message>", "<local-command-stdout>", "[Request interrupted", "Caveat: The messages below", "<user-prompt-submit-hook>"]
PASTE_CHARS = 2000
PASTED_HEAD = r"(?i)^(?:[\w.@~/-]*/[\w.@-]+|[\w.-]+\.(?:md|ts|tsx|js|json|py|txt|log|csv))\b|^(?:report|summary|findings|results?|output)\b[^\n]{0,40}\b(?:is )?(?:at|in)\b"


def scannable() -> Column:
    text = F.trim("text")
    ok = F.col("human") & ~F.coalesce("side", F.lit(False)) & (F.col("kind") == "main") & (F.length(text) >= 3) & ~text.startswith("/")
    for m in MARKERS:
        ok = ok & ~F.contains("text", F.lit(m))
    return ok


def pasted(text: Column) -> Column:
    """A turn that opens on a path or report, or is long and addresses nobody."""
    return F.trim(F.substring_index(text, "\n", 1)).rlike(PASTED_HEAD) | ((F.length(text) > PASTE_CHARS) & ~text.rlike(r"(?i)\byou(?:r|rs)?\b"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return facts.messages(spark, sf).where(scannable()).where(~pasted(F.col("text")))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SCAN = "human AND NOT coalesce(side, false) AND kind = 'main' AND length(trim(text)) >= 3 AND NOT starts_with(trim(text), '/')" + "".join(f" AND NOT contains(text, {_quote(m)})" for m in MARKERS)
_PASTED = rf"(regexp_matches(trim(split_part(text, chr(10), 1)), {_quote(PASTED_HEAD)}) OR (length(text) > {PASTE_CHARS} AND NOT regexp_matches(text, '(?i)\byou(?:r|rs)?\b')))"
_TURNS = with_facts("m", f", h AS (SELECT * FROM m WHERE {_SCAN} AND NOT {_PASTED})")
_MATCHABLE = r"lower(regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?(?:```|$)', ' ', 'g'), '(?m)^\s*>.*$', ' ', 'g'), '(?i)<[a-z-]+>[\s\S]*?</[a-z-]+>', ' ', 'g'))"
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(_TURNS + " SELECT proj, count(*) AS turns, count(DISTINCT sid) AS sessions FROM h GROUP BY proj")
def human_scannable(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).groupBy("proj").agg(F.count("*").alias("turns"), F.countDistinct("sid").alias("sessions"))


def _hits(rows: DataFrame) -> DataFrame:
    """(theme, text) of each turn and each theme one of whose patterns it has; the patterns of a theme are one alternation."""
    text = T.matchable(F.col("text"))
    themes = F.array(*[F.when(text.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(t)) for t, ps in THEMES.items()])
    return rows.select(F.explode(F.array_compact(themes)).alias("theme"), T.collapse(F.col("text")).alias("text"))


_HITS = " UNION ALL ".join(f"SELECT {_quote(t)} AS theme, {_FLAT} AS text FROM h WHERE regexp_matches({_MATCHABLE}, {_quote('|'.join(f'(?:{p})' for p in ps))})" for t, ps in THEMES.items())


@query(_TURNS + f", x AS ({_HITS}) SELECT theme, count(*) AS n, array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(n := length(text), s := text))))[1:3], lambda z: substring(z.s, 1, 220)), chr(10)) AS samples FROM x GROUP BY theme")
def human_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that correct, by theme, with the three shortest of each."""
    x = _hits(turns(spark, sf))
    # The shortest three of distinct texts are found without collecting a theme's texts.
    few = R.top_per_group(x.distinct(), ["theme"], [F.length("text").asc(), F.col("text").asc()], 3)
    samples = few.groupBy("theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: F.substring(s.text, 1, 220)), "\n").alias("samples"))
    return x.groupBy("theme").agg(F.count("*").alias("n")).join(samples, "theme")


_STOP = ", ".join(_quote(w) for w in T.STOPWORDS)
_WORDS = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace({_MATCHABLE}, '[^a-z0-9\s./_-]+', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))))"
_KEY = f"CASE WHEN len({_WORDS}) < 4 THEN '' ELSE array_to_string(({_WORDS})[1:10], ' ') END"


@query(_TURNS + f", k AS (SELECT row_id, {_KEY} AS request_key FROM h) SELECT row_id, request_key FROM k WHERE request_key <> ''")
def request_key(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("row_id", T.request_key(F.col("text")).alias("request_key")).where("request_key <> ''")


@query(_TURNS + rf""", k AS (SELECT sid, {_FLAT} AS flat, {_KEY} AS key FROM h WHERE len(regexp_split_to_array(trim(text), '\s+')) BETWEEN 4 AND 400),
  g AS (SELECT key, count(*) AS n, count(DISTINCT sid) AS sessions, substring(arg_min(flat, (length(flat), flat)), 1, 220) AS label FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT sid) >= 2)
  SELECT *, (SELECT count(*) FROM g) AS total FROM g ORDER BY sessions DESC, key LIMIT {TOP}""")
def human_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that came in several sessions, whatever their word order."""
    rows = turns(spark, sf).where(F.size(F.split(F.trim("text"), r"\s+")).between(4, 400))
    keyed = rows.select("sid", T.collapse(F.col("text")).alias("flat"), T.request_key(F.col("text")).alias("key")).where("key <> ''")
    g = keyed.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("sessions"), F.substring(R.shortest("flat"), 1, 220).alias("label")).where("sessions >= 2")
    return R.ranking(g, "sessions", "key", TOP)


@query(with_facts("ms", f"SELECT (SELECT count(*) FROM m WHERE {_SCAN} AND NOT {_PASTED}) AS turns, (SELECT CAST(coalesce(sum(interrupts), 0) AS BIGINT) FROM s) AS interrupts"))
def human_scalars(spark: SparkSession, sf: str) -> DataFrame:
    interrupts = facts.sessions(spark, sf, "interrupts").agg(F.coalesce(F.sum("interrupts"), F.lit(0)).alias("interrupts"))
    return turns(spark, sf).agg(F.count("*").alias("turns")).crossJoin(F.broadcast(interrupts))  # one row each


@query(with_facts("m", rf"""SELECT row_id, {_FLAT} AS flat, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '…' ELSE text END AS clipped,
  CAST(floor((length(text) + length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))) / 4 + 0.5) AS BIGINT) AS tokens
  FROM m WHERE text IS NOT NULL"""))
def collapse_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Collapsed and clipped texts with their estimated tokens (UTF-16 units over four)."""
    x = F.col("text")
    return facts.messages(spark, sf).where("text is not null").select("row_id", T.collapse(x).alias("flat"), T.clip(x, 60, "…").alias("clipped"), T.est_tokens(x).alias("tokens"))


@query(with_facts("b", r"SELECT row_id, substring(coalesce(trim(list_filter(string_split(out, chr(10)), lambda x: trim(x) <> '')[1]), ''), 1, 200) AS line FROM b WHERE out IS NOT NULL"))
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    return facts.bash(spark, sf).where("out is not null").select("row_id", T.first_line(F.col("out")).alias("line"))


@query(with_facts("m", "SELECT row_id FROM m WHERE regexp_matches(text, " + _quote("^(?:" + "|".join(T.HARNESS_OPENERS) + ")") + ")"))
def machine_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that open like something a harness wrote."""
    return facts.messages(spark, sf).where(T.machine_made(F.col("text"))).select("row_id")


_STRIPPED = "text"
for _tag in T.HARNESS_TAGS:
    _STRIPPED = rf"regexp_replace({_STRIPPED}, '<{_tag}>[\s\S]*?</{_tag}>', '', 'g')"


@query(with_facts("m", f"SELECT row_id, trim({_STRIPPED}) AS stripped FROM m WHERE text LIKE '%<%'"))
def strip_harness(spark: SparkSession, sf: str) -> DataFrame:
    return facts.messages(spark, sf).where("text like '%<%'").select("row_id", T.strip_harness(F.col("text")).alias("stripped"))


QUERIES, ORACLES = query.queries, query.oracles
