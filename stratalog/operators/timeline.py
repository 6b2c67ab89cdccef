"""One session's context, turn by turn: ordered events, model calls, and what filled the window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import numbers as N
from stratalog.operators import lines as L
from stratalog.operators import sequences as S

WINDOW, LIMIT = 1_000_000, 0.40
#: What an attachment of each type loads.
LOADS = {
    "skill_listing": "skills", "agent_listing_delta": "agents", "deferred_tools_delta": "tools", "mcp_instructions_delta": "mcp", "opened_file_in_ide": "ide", "selected_lines_in_ide": "ide",
    "edited_text_file": "ide", "task_reminder": "reminder", "hook_success": "reminder", "date_change": "reminder", "ultra_effort_enter": "reminder", "workflow_keyword_request": "reminder",
}
#: Shares of a budget in their order, and those a compaction empties.
SHARES = ["system_tools", "memory", "listings", "files", "tool_results", "prompts", "assistant_text", "thinking", "other", "unattributed"]
GROWS = ["thinking", "assistant_text", "tool_results", "prompts", "files", "other"]
STAYS = ["memory", "listings"]
EVENTS = "sid string, line_no int, pos int, kind string, ts string, request string, side boolean, title string, body string, load string, tool string, ref string, is_error boolean, tokens bigint"


#: Lines of a session that one task sums up.
CHUNK = 50_000


def _chunk() -> Column:
    return F.floor(F.col("line_no") / CHUNK)


def _size16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def _attachment(a: dict) -> tuple[str, str, str]:
    """(load, title, body) of an attachment."""
    kind = a.get("type") if isinstance(a.get("type"), str) else ""
    content = a.get("content")
    name = next((x for x in (a.get("filename"), a.get("displayPath")) if isinstance(x, str)), "")
    joined = {"agent_listing_delta": ("addedLines", "\n"), "deferred_tools_delta": ("addedNames", ", "), "mcp_instructions_delta": ("addedBlocks", "\n\n")}.get(kind)
    if kind == "file":
        load = "claude-md" if name.lower().endswith(("claude.md", "agents.md")) else "file"
        inner = content.get("file") if isinstance(content, dict) else None
        body = inner["content"] if isinstance(inner, dict) and isinstance(inner.get("content"), str) else L.compact(content) or ""
    else:
        load = LOADS.get(kind, "other")
        if joined:
            parts = a.get(joined[0])
            body = joined[1].join(L.compact(p) or "" for p in parts) if isinstance(parts, list) else ""
        elif kind == "edited_text_file":
            body = L.compact(a.get("snippet")) or ""
        elif kind == "hook_success":
            body = f"$ {L.compact(a.get('command')) or ''}\n{L.compact(a.get('stdout')) or ''}{L.compact(a.get('stderr')) or ''}"
        else:
            body = L.compact(content if content is not None else a) or ""
    if kind in ("file", "edited_text_file", "opened_file_in_ide"):
        title = f"{kind}: {name.rpartition('/')[2] or name}"
    elif kind == "skill_listing":
        title = f"skill_listing ({a.get('skillCount', '?')} skills)"
    else:
        title = kind or "attachment"
    return load, title, body


def _line_events(line: dict, line_no: int) -> Iterator[tuple]:
    """(kind, request, title, body, load, tool, ref, is_error) of the events of a line."""
    kind = line.get("type")
    if kind == "attachment":
        load, title, body = _attachment(line["attachment"] if isinstance(line.get("attachment"), dict) else {})
        yield "attachment", None, title, body, load, None, None, False
    elif kind == "user":
        content, summary = L.message(line).get("content"), line.get("isCompactSummary") is True
        if isinstance(content, str):
            yield ("compaction", None, "Context compaction (summary)", content, None, None, None, False) if summary else ("user-prompt", None, "User prompt", content, None, None, None, False)
        for b in content if isinstance(content, list) else []:
            if isinstance(b, dict) and b.get("type") == "tool_result":
                error = b.get("is_error") is True
                yield "tool-result", None, "tool_result" + " (error)" * error, L.compact(b.get("content")) or "", None, None, b.get("tool_use_id") if isinstance(b.get("tool_use_id"), str) else None, error
            elif isinstance(b, dict) and b.get("type") == "text":
                yield "user-prompt", None, "User message", L.compact(b.get("text")) or "", None, None, None, False
    elif kind == "assistant":
        request = line["requestId"] if isinstance(line.get("requestId"), str) else f"line-{line_no}"
        content = L.message(line).get("content")
        for b in content if isinstance(content, list) else []:
            if not isinstance(b, dict):
                continue
            if b.get("type") == "thinking":
                yield "assistant-thinking", request, "Thinking", L.compact(b.get("thinking")) or "", None, None, None, False
            elif b.get("type") == "text":
                yield "assistant-text", request, "Assistant", L.compact(b.get("text")) or "", None, None, None, False
            elif b.get("type") == "tool_use":
                name = b["name"] if isinstance(b.get("name"), str) else "tool"
                yield "tool-call", request, name, pretty(b.get("input") or {}), None, name, b.get("id") if isinstance(b.get("id"), str) else None, False
    elif kind == "summary":
        yield "summary", None, "Rolling summary", L.compact(line.get("summary")) or "", None, None, None, False
    elif kind == "system":
        sub = line.get("subtype")
        yield "system", None, f"system: {sub if isinstance(sub, str) else 'event'}", L.compact(line.get("content", sub)) or "", None, None, None, False


def pretty(value: object) -> str:
    """JSON with an indent of two, as tool inputs are shown and measured."""
    return L.dumps(value, indent=2, ascii_only=False)


def _events(bodies: bool) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for sid, line_no, raw in rows:
            line = L.parse(raw)
            if line is None:
                continue
            ts = line["timestamp"] if isinstance(line.get("timestamp"), str) else None
            for pos, (kind, request, title, body, load, tool, ref, error) in enumerate(_line_events(line, line_no)):
                tokens = 0 if kind == "system" else (_size16(body) + 2) // 4
                text = body.encode("utf-8", "replace").decode() if bodies else None
                yield sid, line_no, pos, kind, ts, request, line.get("isSidechain") is True, title if bodies else None, text, load, tool, ref, error, tokens

    return each


def events(lines: DataFrame, bodies: bool = True) -> DataFrame:
    """Typed events of all lines (sid, line_no, raw), ordered by (line_no, pos), with `tokens` estimated from the body; system events weigh nothing.

    bodies: whether titles and bodies come along; sums need their sizes only, and those are taken where the line is parsed.
    """
    return L.visit(lines.withColumn("line_no", F.col("line_no").cast("int")), ["sid", "line_no", "raw"], EVENTS, _events(bodies))


def weigh(found: DataFrame) -> DataFrame:
    size = F.octet_length(F.encode("body", "UTF-16BE")) / 2
    return found.withColumn("tokens", F.when(F.col("kind") == "system", F.lit(0)).otherwise(F.floor(size / 4 + 0.5)).cast("bigint"))


def turns(parsed: DataFrame, own_window: bool = False) -> DataFrame:
    """Model calls of a session in order: first line of each requestId with context, side chains left out unless the file is one (own_window)."""
    u = "line.message.usage"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ctx = zero(f"{u}.input_tokens") + zero(f"{u}.cache_read_input_tokens") + zero(f"{u}.cache_creation_input_tokens")
    rows = parsed.where("line.type = 'assistant'").select(
        "sid", F.coalesce("line.requestId", F.concat(F.lit("line-"), F.col("line_no").cast("string"))).alias("request"), "line_no", F.col("line.timestamp").alias("ts"), F.coalesce("line.message.model", F.lit("unknown")).alias("model"),
        ctx.alias("ctx"), zero(f"{u}.cache_read_input_tokens").alias("cache_read"), zero(f"{u}.output_tokens").alias("output"), (F.col("line.isSidechain") == "true").alias("side"),
    ).where("ctx > 0")
    if not own_window:
        rows = rows.where("not coalesce(side, false)")
    first = rows.groupBy("sid", "request").agg(F.min_by(F.struct("line_no", "ts", "model", "ctx", "cache_read", "output"), "line_no").alias("f")).select("sid", "request", "f.*")
    counted = S.prefix_sums(first.withColumn("one", F.lit(1)), ["sid"], ["line_no"], ["one"], _chunk())
    return counted.withColumn("turn", F.col("before_one").cast("int")).drop("one", "before_one")


def peaks(turn_rows: DataFrame) -> DataFrame:
    """Per session: largest context, the first turn that has it, what it read from the cache, all output, last context, turns."""
    best = F.struct("ctx", -F.col("turn"))
    return turn_rows.groupBy("sid").agg(
        F.max("ctx").alias("peak_ctx"), F.max_by("turn", best).alias("peak_turn"), F.max_by("cache_read", best).alias("peak_cache_read"), F.sum("output").alias("total_output"),
        F.max_by("ctx", "turn").alias("final_ctx"), F.count("*").alias("turns"),
    )


def dumb_zone(turn_rows: DataFrame, window: int = WINDOW, limit: float = LIMIT) -> DataFrame:
    """Per session: the first turn at or over the share of the window (-1 when none), and how many there are."""
    over = F.col("ctx") >= limit * window
    return turn_rows.groupBy("sid").agg(F.coalesce(F.min(F.when(over, F.col("turn"))), F.lit(-1)).alias("cross_turn"), F.count_if(over).alias("turns_over"))


def share_of(load: Column, kind: Column) -> Column:
    """The budget share that an event's tokens go to; null for model output, which is counted by turn."""
    return (
        F.when(load == "claude-md", "memory").when(load.isin("skills", "agents", "tools", "mcp"), "listings").when(load.isin("file", "ide"), "files").when(load.isin("reminder", "other"), "other")
        .when(kind == "tool-result", "tool_results").when(kind.isin("user-prompt", "compaction"), "prompts").when(kind == "summary", "other")
    )


def placed(event_rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Events with their turn, if they are of one, and its numbers."""
    return event_rows.join(turn_rows.select("sid", "request", "turn", "ctx", "output", "cache_read", "model"), ["sid", "request"], "left")


def residual(event_rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """Per session: the first turn's context beyond everything seen before that turn: system prompt and tools."""
    first = turn_rows.where("turn = 0").select("sid", F.col("ctx").alias("first_ctx"), "request")
    starts = event_rows.join(first.select("sid", "request"), ["sid", "request"], "left_semi").groupBy("sid").agg(F.min(F.struct("line_no", "pos")).alias("start"))
    before = event_rows.join(starts, "sid").where(F.struct("line_no", "pos") < F.col("start")).groupBy("sid").agg(F.sum("tokens").alias("seen"))
    return first.join(before, "sid", "left").select("sid", F.greatest(F.lit(0), F.col("first_ctx") - F.coalesce("seen", F.lit(0))).alias("system_tokens"))


def snapshots(event_rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """(sid, turn, ctx, output, a column for each of SHARES): what the context of each turn was made of.

    Running sums in event order; a compaction starts a new epoch for the shares that grow. A turn's own output
    counts from the next turn on: its visible part as assistant_text, the rest as thinking. Shares always
    sum to the context: estimates are scaled down when they overshoot, else the rest is unattributed.
    Sums run in chunks of CHUNK lines with offsets, so a session of any length is many tasks.
    """
    e = placed(event_rows, turn_rows)
    order = ["line_no", "pos"]
    of_turn = e.where("turn is not null").groupBy("sid", "turn").agg(
        F.min(F.struct("line_no", "pos")).alias("at"), F.max("ctx").alias("ctx"), F.max("output").alias("output"), F.sum(F.when(F.col("kind").isin("assistant-text", "tool-call"), F.col("tokens")).otherwise(0)).alias("visible")
    )
    outputs = of_turn.select("sid", F.col("at.line_no").alias("line_no"), F.col("at.pos").alias("pos"), "turn", "ctx", "output", F.col("visible").alias("assistant_text"), F.greatest(F.lit(0), F.col("output") - F.col("visible")).alias("thinking"), F.lit(0).alias("compacts"))
    rest = e.where("turn is null and not side").withColumn("share", share_of(F.col("load"), F.col("kind")))
    loads = rest.select("sid", *order, (F.col("kind") == "compaction").cast("int").alias("compacts"), *[F.when(F.col("share") == s, F.col("tokens")).otherwise(0).alias(s) for s in ("memory", "listings", "files", "tool_results", "prompts", "other")])
    steps = outputs.unionByName(loads, allowMissingColumns=True).fillna(0, GROWS + STAYS)
    # A turn is shown before its own output is added, so sums are over earlier rows.
    steps = S.prefix_sums(steps, ["sid"], order, ["compacts", *STAYS], _chunk())
    steps = steps.withColumn("epoch", F.col("before_compacts") + F.col("compacts"))
    steps = S.prefix_sums(steps, ["sid", "epoch"], order, GROWS, _chunk())
    shown = steps.withColumns({f"_{s}": F.col(f"before_{s}") for s in GROWS + STAYS}).where("turn is not null").join(residual(event_rows, turn_rows), "sid")
    floor = F.least("system_tokens", "ctx")
    room = F.greatest(F.lit(0), F.col("ctx") - floor)
    total = sum((F.col(f"_{s}") for s in (GROWS + STAYS)[1:]), F.col(f"_{GROWS[0]}"))
    scale = F.when((total > room) & (total > 0), room / total).otherwise(1.0)
    scaled = {s: F.col(f"_{s}") * F.col("scale") for s in GROWS + STAYS}
    shown = shown.withColumns({"floor": floor, "room": room, "total": total}).withColumn("scale", scale)
    columns = {"system_tools": F.col("floor").cast("double"), **scaled, "unattributed": F.when(F.col("scale") < 1, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("room") - F.col("total")).cast("double")))}
    return shown.select("sid", "turn", "ctx", "output", *[columns[s].alias(s) for s in SHARES])


def compaction_turns(event_rows: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """(sid, turn) of the first turn after each compaction; two compactions before one turn give one row."""
    e = placed(event_rows, turn_rows)
    later = Window.partitionBy("sid").orderBy("line_no", "pos").rowsBetween(1, Window.unboundedFollowing)
    return e.withColumn("next", F.first("turn", ignorenulls=True).over(later)).where("kind = 'compaction' and not side and turn is null and next is not null").select("sid", F.col("next").alias("turn")).distinct()


def budget(snapshot_rows: DataFrame, peak_rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The shares at each session's peak turn, those above zero, with their part of context and window; `heavy` above a quarter."""
    at = snapshot_rows.join(peak_rows.select("sid", F.col("peak_turn").alias("turn")), ["sid", "turn"])
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("share"), F.col(s).alias("tokens")) for i, s in enumerate(SHARES)])
    rows = at.select("sid", "ctx", F.explode(pairs).alias("p")).select("sid", "ctx", "p.*").where("tokens > 0")
    of_ctx = N.safe_div(F.col("tokens"), F.col("ctx"))
    return rows.select("sid", "ord", "share", "tokens", of_ctx.alias("of_context"), (F.col("tokens") / window).alias("of_window"), (of_ctx > 0.25).alias("heavy"))


ROLLOUT = "sid string, line_no int, kind string, ts string, title string, body string, tool string, ref string, model string, closes boolean, input bigint, cached bigint, output bigint, window bigint, load string"


def _rollout(rows: Iterator[tuple]) -> Iterator[tuple]:
    def words(content: object) -> str:
        if isinstance(content, list):
            return "\n".join(L.compact(c.get("text")) or "" for c in content if isinstance(c, dict))
        return L.compact(content) or ""

    def whole(x: object) -> int:
        return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0

    for sid, line_no, raw in rows:
        line = L.parse(raw)
        p = line.get("payload") if line else None
        if not isinstance(p, dict):
            continue
        kind, what, ts = line.get("type"), p.get("type"), L.compact(line.get("timestamp"))
        out = None
        if kind == "turn_context" and p.get("model"):
            yield sid, line_no, "meta", ts, "", "", None, None, L.compact(p["model"]), False, 0, 0, 0, None, None
        elif kind == "event_msg" and what == "token_count":
            info = p.get("info") if isinstance(p.get("info"), dict) else {}
            last = info.get("last_token_usage") if isinstance(info.get("last_token_usage"), dict) else {}
            used = whole(last.get("input_tokens"))
            yield sid, line_no, "usage", ts, "", "", None, None, None, used > 0, used, whole(last.get("cached_input_tokens")), whole(last.get("output_tokens")) + whole(last.get("reasoning_output_tokens")), whole(info.get("model_context_window")) or None, None
        elif kind == "response_item":
            call = L.compact(p.get("call_id"))
            if what == "message":
                role, text = p.get("role"), words(p.get("content"))
                out = ("assistant-text", "Assistant", text, None, None, None) if role == "assistant" else ("user-prompt", "User prompt", text, None, None, None) if role == "user" else ("attachment", f"{role} instructions", text, None, None, "other")
            elif what == "reasoning":
                out = ("assistant-thinking", "Reasoning", words(p.get("content")), None, None, None)
            elif what in ("function_call", "local_shell_call", "custom_tool_call"):
                name = L.compact(p.get("name")) or what
                out = ("tool-call", name, L.compact(next((p[k] for k in ("arguments", "action") if p.get(k) is not None), {})) or "", name, call, None)
            elif what == "web_search_call":
                out = ("tool-call", "web_search", L.compact(p.get("action", p)) or "", "web_search", None, None)
            elif what in ("function_call_output", "local_shell_call_output"):
                out = ("tool-result", "function_call_output", L.compact(p.get("output")) or "", None, call, None)
        if out:
            yield sid, line_no, out[0], ts, out[1], out[2], out[3], out[4], None, False, 0, 0, 0, None, out[5]


def rollout(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, turns) of logs in the second format, in the shape of events() and turns().

    A usage record with input closes a turn; input already includes what was cached; model output since the last close is of that
    turn, and output after the last one stays with the last turn.
    """
    found = L.visit(lines.withColumn("line_no", F.col("line_no").cast("int")), ["sid", "line_no", "raw"], ROLLOUT, _rollout)
    order = Window.partitionBy("sid").orderBy("line_no")
    closed = F.coalesce(F.sum(F.col("closes").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    model = F.last("model", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seq = found.withColumns({"turn": closed.cast("int"), "now": model, "_all": F.sum(F.col("closes").cast("int")).over(Window.partitionBy("sid"))})
    turn_rows = seq.where("closes").select("sid", F.format_string("rollout-turn-%d", "turn").alias("request"), "line_no", "ts", F.coalesce("now", F.lit("unknown")).alias("model"), F.col("input").alias("ctx"), F.col("cached").alias("cache_read"), "output", "turn")
    mine = F.col("kind").startswith("assistant") | (F.col("kind") == "tool-call")
    at = F.least("turn", F.col("_all").cast("int") - 1)
    event_rows = seq.where("kind not in ('meta', 'usage')").select(
        "sid", "line_no", F.lit(0).alias("pos"), "kind", "ts", F.when(mine & (at >= 0), F.format_string("rollout-turn-%d", at)).alias("request"), F.lit(False).alias("side"), "title", "body", "load", "tool", "ref", F.lit(False).alias("is_error")
    )
    return weigh(event_rows), turn_rows
