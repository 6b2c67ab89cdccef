"""The HTML reports: one session, one vault, all vaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.redaction import LABELLED, redact
from stratalog.operators import timeline as TL
from stratalog.operators import vault as V
from stratalog.render import svg
from stratalog.render.sinks import html_table, page, rows_of

#: Rows of a session's history that its page shows (it says how many there are), and turns that a chart takes.
TIMELINE_ROWS, TURNS = 5_000, 1_000_000


def _clean(rows: list[dict]) -> list[dict]:
    """Rows of a page with secrets in their texts replaced."""
    return [{k: redact(v, LABELLED) if isinstance(v, str) else v for k, v in r.items()} for r in rows]


METHOD = "A token is four characters; what a turn's context holds beyond the known texts is shared out in proportion, and what no text accounts for is unattributed."


def session_page(sid: str, events: DataFrame, turns: DataFrame, window: int = TL.WINDOW, limit: float = TL.LIMIT, subagents: DataFrame | None = None) -> str:
    """A session's report: gauge, budget, timeline chart, largest items, history."""
    e, t = events.where(F.col("sid") == sid), turns.where(F.col("sid") == sid)
    shots, peaks = TL.snapshots(e, t), TL.peaks(t)
    head = (rows_of(peaks) or [{"peak_ctx": 0, "turns": 0}])[0]
    share = head["peak_ctx"] / window
    zone = "ok" if share < limit else "warn" if share < max(0.75, (1 + limit) / 2 if limit >= 0.75 else 0.75) else "bad"
    budget = rows_of(TL.budget(shots, peaks, window).orderBy("ord"))
    largest = rows_of(e.where("kind <> 'system' and tokens > 0").orderBy(F.desc("tokens"), "line_no", "pos").limit(25).select("kind", "title", "tokens"))
    history = rows_of(e.orderBy("line_no", "pos").limit(TIMELINE_ROWS).select("line_no", "kind", "title", "tokens"))
    turn_rows = rows_of(shots.orderBy("turn"), TURNS)
    cuts = [r["turn"] for r in rows_of(TL.compaction_turns(e, t), TURNS)]
    counts = rows_of(e.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "user-prompt").alias("prompts"), F.count_if(F.col("kind") == "tool-call").alias("tool_calls"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("first"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("last")))[0]
    loaded = rows_of(e.where("load is not null and load <> ''").groupBy("load", "title").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "load", "title"))
    shown = f"<p>{min(TIMELINE_ROWS, counts['events']):,} of {counts['events']:,} events are shown</p>" if counts["events"] > TIMELINE_ROWS else ""
    parts = [
        svg.gauge(share, zone), f"<p>peak {head['peak_ctx']:,} of {window:,} tokens in {head['turns']} turns</p>", "<h2>Counts</h2>", html_table([counts]), "<h2>Budget at the peak</h2>", html_table([{k: r[k] for k in ("share", "tokens", "of_context", "heavy")} for r in budget]),
        "<h2>Timeline</h2>", svg.timeline(turn_rows, TL.SHARES, window, limit, cuts), "<h2>Loaded</h2>", html_table(_clean(loaded)),
        "<h2>Largest items</h2>", html_table(_clean(largest)), "<h2>History</h2>", shown, html_table(_clean(history)), *(["<h2>Subagents</h2>", html_table(_clean(rows_of(subagents)))] if subagents is not None else []), "<h2>Method</h2>", f"<p>{METHOD}</p>",
    ]
    return page(f"Session {sid}", parts, {"turns": turn_rows, "budget": budget})


def vault_page(vault: str, notes: DataFrame, resolved: DataFrame, findings: DataFrame) -> str:
    """A vault's report: findings by note, link graph, files."""
    n = notes.where(F.col("vault") == vault)
    files = rows_of(n.select("slug", F.octet_length("text").alias("bytes"), "type").orderBy("slug"))
    links = rows_of(resolved.where((F.col("vault") == vault) & (F.col("hits") > 0)).select(F.col("slug").alias("a"), F.col("target").alias("b")).distinct())
    found = _clean([r.asDict(recursive=True) for r in V.ordered(findings.where(F.col("vault") == vault)).toLocalIterator()])
    worst = rows_of(V.triage(findings.where(F.col("vault") == vault)).drop("vault"))
    severities = {s: sum(r["severity"] == s for r in found) for s in V.RANKS}
    nodes = [{"slug": (f["slug"] or "").lower(), "bytes": f["bytes"]} for f in files]
    parts = ["<h2>Findings</h2>", svg.donut(list(severities.items())), html_table(_clean(worst)), html_table(found), "<h2>Links</h2>", svg.arcs(nodes, [(r["a"].lower(), r["b"]) for r in links if r["a"]]), "<h2>Files</h2>", html_table(_clean(files))]
    return page(f"Vault {vault}", parts, {"findings": found})


def all_vaults_page(overview: DataFrame) -> str:
    """Every vault in one table, the largest first."""
    return page("All vaults", [html_table(_clean(rows_of(overview.orderBy(F.desc("notes"), "vault"))))])
