"""Transcript trees and raw lines into typed facts.

Layout: <root>/<project>/<sid>.jsonl, <project>/<sid>/subagents/agent-<id>.jsonl and
<project>/<sid>/subagents/workflows/wf_<run>/agent-<id>.jsonl; journal.jsonl files are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions import numbers as N
from stratalog.functions import text as T
from stratalog.functions import shell
from stratalog.operators import lines as L
from stratalog.sources.tables import checkpointed

USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
HEAD = ("type", "timestamp", "cwd", "gitBranch", "version", "isSidechain", "requestId")
STOPPED = "[Request interrupted"
LINE = f"struct<{', '.join(f'{c}: string' for c in HEAD)}, message: struct<id: string, model: string, usage: struct<{', '.join(f'{c}: bigint' for c in USAGE)}>>, interrupted: boolean, stopped: boolean>"


#: Splits of files whose offsets are broadcast at most.
SPLITS = 500_000


def read_tree(spark: SparkSession, root: str, projects: list[str] | None = None, modified_after: str | None = None) -> DataFrame:
    """Lines of all transcripts below `root`: file, proj, sid, kind, parent, run, line_no, raw.

    projects: keep project folders whose name contains any of them. modified_after: skip older files unread (ISO, UTC).
    Files are split by Spark; a line's number is its place in its split plus the lines of the splits before, which are counted
    first. Texts are shuffled only when there are more than SPLITS splits to join with.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    meta = F.col("_metadata")
    df = reader.text(root).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    df = located(df, root, projects)
    # Places of lines in a task are those of the same scan, so both readings of it agree.
    splits = df.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = checkpointed(splits.select("file", "_block", (before - F.col("_first") + 1).alias("_shift")))
    few = splits.limit(SPLITS + 1).count() <= SPLITS
    df = df.join(F.broadcast(splits) if few else splits, ["file", "_block"])
    return df.withColumn("line_no", (F.col("_at") + F.col("_shift")).cast("int")).drop("_block", "_at", "_rel", "_shift")


def located(df: DataFrame, root: str, projects: list[str] | None = None) -> DataFrame:
    """Rows with a `file` below `root`, journals and other projects left out, with proj and what classify() says."""
    prefix = root.rstrip("/").removeprefix("file:").replace("//", "/")
    rel = F.split(F.substring_index(F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "^file:/+", "/"), prefix + "/", -1), "/")
    df = df.withColumns({"_rel": rel}).where(F.element_at("_rel", -1) != "journal.jsonl").withColumn("proj", F.col("_rel")[0])
    if projects is not None:
        df = df.where(F.exists(F.array(*[F.lit(p) for p in projects]), lambda p: F.contains(F.col("proj"), p)))
    return df.withColumns(classify(F.col("_rel")))


def classify(parts: Column) -> dict[str, Column]:
    """sid, kind, parent and run from a path's parts below the root."""
    run = F.try_element_at(F.filter(parts, lambda p: p.startswith("wf_")), F.lit(1))
    below = F.size(parts) > 2
    return {
        "sid": F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""),
        "kind": F.when(~below, "main").when(run.isNotNull(), "workflow-agent").otherwise("subagent"),
        "parent": F.when(below, parts[1]),
        "run": run,
    }


def _whole(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def _line(line: dict) -> dict:
    message, result = line.get("message"), line.get("toolUseResult")
    out = {c: L.compact(line.get(c)) for c in HEAD}
    if isinstance(message, dict):
        usage = message.get("usage")
        out["message"] = {"id": L.compact(message.get("id")), "model": L.compact(message.get("model")), "usage": {c: _whole(usage.get(c)) for c in USAGE} if isinstance(usage, dict) else None}
        out["stopped"] = STOPPED in (L.compact(message.get("content")) or "")
    out["interrupted"] = isinstance(result, dict) and result.get("interrupted") is True
    return out


def parse(lines: DataFrame) -> DataFrame:
    """Lines (sid, line_no, raw) as (sid, line_no, line), `line` being a struct of what sessions and turns are made of.

    Blank and broken lines, and such as have something behind their object, are dropped; objects nested to any depth are
    read. A field of an unexpected type is text, or null where a number is wanted, never an error.
    """

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for sid, line_no, raw in rows:
            line = L.parse(raw)
            if line is not None:
                yield sid, line_no, _line(line)

    return L.visit(lines.withColumn("line_no", F.col("line_no").cast("int")), ["sid", "line_no", "raw"], f"sid string, line_no int, line {LINE}", each)


def turns(parsed: DataFrame) -> DataFrame:
    """Model calls: the first line with usage of each request (requestId, else message id, else the line itself)."""
    with_usage = parsed.where("line.type = 'assistant' and line.message.usage is not null")
    key = F.coalesce("line.requestId", "line.message.id", F.concat(F.lit("line-"), F.col("line_no").cast("string")))
    usage = {c: F.coalesce(f"line.message.usage.{c}", F.lit(0)) for c in USAGE}
    flat = with_usage.select("sid", key.alias("request"), "line_no", F.col("line.message.model").alias("model"), F.col("line.isSidechain").alias("side"), *[c.alias(n) for n, c in usage.items()])
    first = flat.groupBy("sid", "request").agg(F.min_by(F.struct(*[c for c in flat.columns if c not in ("sid", "request")]), "line_no").alias("f"))
    out = first.select("sid", "request", "f.*")
    return out.withColumn("ctx", F.col("input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_creation_input_tokens"))


def session_fold(parsed: DataFrame) -> DataFrame:
    """Per session: first cwd, last branch and version that are set, first and last timestamp in line order, line counts."""
    def at(field: str, last: bool) -> Column:
        c = F.nullif(F.col(f"line.{field}"), F.lit(""))
        return (F.max_by if last else F.min_by)(c, F.when(c.isNotNull(), F.col("line_no")))

    return parsed.groupBy("sid").agg(
        at("cwd", False).alias("cwd"), at("gitBranch", True).alias("branch"), at("version", True).alias("ver"), at("timestamp", False).alias("first_ts"), at("timestamp", True).alias("last_ts"),
        F.count_if(F.col("line.type") == "assistant").alias("assistant_msgs"), F.count_if(F.col("line.type") == "user").alias("user_msgs"),
    )


def session_tokens(turn_rows: DataFrame) -> DataFrame:
    """Per session: summed usage, largest context, and the first turn's cache write."""
    return turn_rows.groupBy("sid").agg(
        F.count("*").alias("turns"), F.sum("input_tokens").alias("in_tokens"), F.sum("output_tokens").alias("out_tokens"), F.sum("cache_read_input_tokens").alias("cache_read"),
        F.sum("cache_creation_input_tokens").alias("cache_create"), F.max("ctx").alias("max_ctx"), F.min_by("cache_creation_input_tokens", "line_no").alias("first_turn_cache_create"),
    )


#: Characters kept of arguments, messages, outputs of calls that went well and of failed ones, and errors.
ARG, MESSAGE, OUT_OK, OUT_ERR, ERROR = 500, 4000, 200, 600, 600
BLOCKS = "sid string, line_no int, pos int, path string, parent_path string, kind string, id string, name string, ref string, is_error boolean, text string, input string, ts string, model_call string, meta boolean, side boolean, stdout string, stderr string, line_type string"


def _result_text(block: dict, line: dict) -> str:
    content = block.get("content")
    if isinstance(content, list):
        text = "\n".join((L.compact(b.get("text")) or "") if isinstance(b, dict) and b.get("type") == "text" else "" for b in content)
    else:
        text = L.compact(content) or ""
    if not text and isinstance(line.get("toolUseResult"), dict):
        r = line["toolUseResult"]
        text = (L.compact(r.get("stdout")) or "") + (L.compact(r.get("stderr")) or "")
    return text


def _blocks(rows):
    for sid, line_no, raw in rows:
        line = L.parse(raw)
        if line is None:
            continue
        m = L.message(line)
        content = m.get("content")
        top = [{"type": "text", "text": content}] if isinstance(content, str) else [b if isinstance(b, dict) else {"type": "text", "text": b} for b in content if isinstance(b, (dict, str))] if isinstance(content, list) else []
        for pos, b in enumerate(top):
            kind = b.get("type") if isinstance(b.get("type"), str) else ""
            text = _result_text(b, line) if kind == "tool_result" else L.compact(b.get("text") if kind != "thinking" else b.get("thinking"))
            given = b.get("input")
            strings = {k: b.get(k) if isinstance(b.get(k), str) else None for k in ("id", "name", "tool_use_id")}
            call = next((x for x in (line.get("requestId"), m.get("id")) if isinstance(x, str)), None)
            yield (
                sid, line_no, pos, str(pos), "", kind, strings["id"], strings["name"], strings["tool_use_id"], b.get("is_error") is True, text, L.compact(given) if isinstance(given, dict) else None,
                L.compact(line.get("timestamp")), call, line.get("isMeta") is True, line.get("isSidechain") is True, None, None, line.get("type") if isinstance(line.get("type"), str) else None,
            )


def content_blocks(lines: DataFrame) -> DataFrame:
    """Top-level content blocks of every valid line, in order (line_no, pos), with a result's text flattened."""
    return L.visit(lines.withColumn("line_no", F.col("line_no").cast("int")), ["sid", "line_no", "raw"], BLOCKS, _blocks)


def call_results(blocks: DataFrame, clean: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Tool rows: calls joined to their results within a session.

    A result without a call is tool `unknown`, without duration; a call without a result isn't an error and has no output;
    of repeated ids the first counts on either side. Columns: sid, id, tool, t_ms, dur_sec, err, out_chars, arg, open, line_no, side,
    input, text. `clean` is what redacts: arguments are redacted whole and clipped then, so nothing survives on a cut.
    """
    order = F.struct("line_no", "pos")
    # An aggregate, not a window: repeated ids shrink before the shuffle.
    def first(rows: DataFrame, key: str, cols: list[Column]) -> DataFrame:
        kept = rows.where(F.col(key).isNotNull()).select("sid", F.col(key).alias("_id"), F.struct(order.alias("o"), *cols).alias("r"))
        return kept.groupBy("sid", "_id").agg(F.min_by("r", F.col("r.o")).alias("r"))

    calls = first(blocks.where("kind = 'tool_use'"), "id", [F.col("name"), N.epoch_ms(F.col("ts")).alias("ms"), F.col("input"), F.col("line_no"), F.col("side")])
    results = first(blocks.where("kind = 'tool_result'"), "ref", [N.epoch_ms(F.col("ts")).alias("ms"), F.col("is_error"), T.length16(F.col("text")).alias("chars"), F.col("line_no"), F.col("text"), F.col("side")])
    both = calls.withColumnRenamed("r", "c").join(results.withColumnRenamed("r", "r"), ["sid", "_id"], "full_outer")
    tool = F.coalesce("c.name", F.lit("unknown"))
    return both.select(
        "sid", F.col("_id").alias("id"), tool.alias("tool"), F.coalesce("c.ms", "r.ms").alias("t_ms"), F.when(F.col("c").isNotNull(), N.duration_sec(F.col("c.ms"), F.col("r.ms"))).alias("dur_sec"),
        F.coalesce("r.is_error", F.lit(False)).alias("err"), F.coalesce("r.chars", F.lit(0)).alias("out_chars"), T.clip(clean(T.primary_arg(tool, F.col("c.input"))), ARG).alias("arg"),
        F.col("r").isNull().alias("open"), F.coalesce("r.line_no", "c.line_no").alias("line_no"), F.coalesce("c.side", "r.side").alias("side"), F.col("c.input").alias("input"), F.col("r.text").alias("text"),
    )


def bash_rows(calls: DataFrame, clean: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Shell calls (rows of call_results) with command, its family and program, whether it ran in the background, and an excerpt of the output."""
    given = lambda key: F.get_json_object("input", f"$.{key}")
    rows = calls.where("tool = 'Bash'").withColumn("cmd", F.coalesce(given("command"), given("cmd"), F.lit("")))
    rows = rows.withColumn("norm", shell.normalize_udf()("cmd")).withColumn("out", clean(F.when(F.col("open"), "").otherwise(F.col("text"))))
    return rows.drop("arg").withColumns({
        "cmd": clean(F.col("cmd")), "desc": given("description"), "family": F.col("norm.family"), "bin": F.col("norm.bin"), "bg": F.coalesce(given("run_in_background") == "true", F.lit(False)) | F.col("norm.background"),
        "out": F.when(F.col("err"), T.clip(F.col("out"), OUT_ERR)).otherwise(T.clip(F.col("out"), OUT_OK)),
    }).drop("norm", "input", "text", "open")


def error_rows(calls: DataFrame, clean: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Failed calls with input and message, redacted and then clipped, and the message's signature."""
    rows = calls.where("err").withColumns({"input": T.clip(clean(F.coalesce("input", F.lit("{}"))), ERROR), "msg": T.clip(clean(F.coalesce("text", F.lit(""))), ERROR)})
    return rows.withColumn("sig", T.error_signature(F.col("msg"))).drop("arg", "text", "open")


def tree_facts(spark: SparkSession, root: str, projects: list[str] | None = None, since: str | None = None, clean: Callable[[Column], Column] = lambda c: c) -> dict[str, DataFrame]:
    """The five fact tables of a transcript tree, by the names and columns that reports read.

    since (ISO, UTC): files that weren't touched since then are skipped unread, and sessions whose last timestamp (or else
    their file's) is older are dropped; a session that is kept keeps all its rows. The tree is parsed twice, for the sessions'
    lines and for the blocks, and both are written once; row_id numbers the rows of that writing.
    """
    lines = read_tree(spark, root, projects, since)
    parsed, blocks = checkpointed(parse(lines)), checkpointed(content_blocks(lines))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    listed = (listed.option("modifiedAfter", since) if since else listed).load(root).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"))
    files = located(listed, root, projects).drop("_rel").dropDuplicates(["sid"])

    calls = checkpointed(call_results(blocks, clean).withColumn("row_id", F.monotonically_increasing_id()))
    count_map = lambda df, key: df.groupBy("sid", key).agg(F.count("*").alias("n")).groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias(f"{key}s"))
    turn_rows = turns(parsed)
    epoch = lambda c: F.floor(N.epoch_ms(F.col(c)) / 1000)
    sessions = files.join(session_fold(parsed), "sid", "left").join(session_tokens(turn_rows), "sid", "left").join(interrupts(parsed), "sid", "left")
    sessions = sessions.join(count_map(turn_rows.where("model <> ''"), "model"), "sid", "left").join(count_map(calls.where("not open or tool <> 'unknown'"), "tool"), "sid", "left")
    sessions = sessions.join(calls.where("err").groupBy("sid").agg(F.count("*").alias("errors")), "sid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    names = {"assistant_msgs": "assistantMsgs", "user_msgs": "userMsgs", "in_tokens": "inTokens", "out_tokens": "outTokens", "cache_read": "cacheReadTokens", "cache_create": "cacheCreateTokens", "max_ctx": "maxCtx",
             "first_turn_cache_create": "firstTurnCacheCreate", "interrupts": "interrupts", "errors": "errors"}
    seen = F.timestamp_seconds("mtime").alias("ingested_at")
    sessions = sessions.select("sid", "proj", "file", "bytes", "cwd", "branch", "ver", epoch("first_ts").alias("start"), epoch("last_ts").alias("end"), "kind", "parent", "run", *[zero(a).alias(b) for a, b in names.items()], "models", "tools", seen)
    if since:
        sessions = sessions.where(F.coalesce("end", F.unix_timestamp("ingested_at")) >= F.unix_timestamp(F.lit(since).cast("timestamp")))
    sessions = checkpointed(sessions)
    of = sessions.select("sid", "proj", "kind", "ingested_at")
    common = {"t_ms": F.floor(F.col("t_ms") / 1000).alias("t"), "dur_sec": F.col("dur_sec").alias("durSec"), "out_chars": F.col("out_chars").alias("outChars")}

    def fact(df: DataFrame, *columns: str) -> DataFrame:
        return df.join(of, "sid").select("row_id", "sid", "proj", "kind", *[common.get(c, F.col(c)) for c in columns], "side", "ingested_at")

    people = user_messages(blocks.join(of.select("sid", F.col("kind").alias("_kind")), "sid"), F.col("_kind"), clean).withColumn("row_id", F.monotonically_increasing_id())
    return {
        "session_rows": sessions,
        "tool_rows": fact(calls, "t_ms", "tool", "dur_sec", "err", "out_chars", "arg"),
        "bash_rows": fact(bash_rows(calls, clean), "t_ms", "dur_sec", "err", "out_chars", "cmd", "desc", "family", "bin", "bg", "out"),
        "user_msg_rows": fact(people, "t", "text", "human"),
        "error_rows": fact(error_rows(calls, clean), "t_ms", "tool", "input", "msg", "sig"),
    }


def user_messages(blocks: DataFrame, kind: Column, clean: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """User texts: one row a text block, harness blocks stripped (the raw text where nothing is left), redacted by `clean` and then clipped; `human` says a person wrote it."""
    rows = blocks.where("line_type = 'user' and kind = 'text' and text <> ''")
    stripped = T.strip_harness(F.col("text"))
    human = (kind == "main") & ~F.col("side") & ~F.col("meta") & (stripped != "") & ~T.machine_made(F.col("text"))
    return rows.select("sid", "line_no", "pos", F.floor(N.epoch_ms(F.col("ts")) / 1000).alias("t"), T.clip(clean(F.when(stripped == "", F.col("text")).otherwise(stripped)), MESSAGE).alias("text"), "side", human.alias("human"))


def interrupts(parsed: DataFrame) -> DataFrame:
    """Interruptions of each session: the flag of a result, and the marker in texts (one stop can count twice)."""
    user = F.col("line.type") == "user"
    return parsed.groupBy("sid").agg((F.count_if(user & F.col("line.interrupted")) + F.count_if(user & F.col("line.stopped"))).alias("interrupts"))
