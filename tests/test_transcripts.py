"""A generated transcript tree, its facts, and the timeline of a session."""

import json

import pytest
from pyspark.sql import functions as F

from stratalog.operators import timeline as TL
from stratalog.sources import local
from stratalog.sources import transcripts as X


def assistant(request, content, ts="2026-01-01T00:00:00.000Z", usage=(10, 20, 30, 40), **kw):
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return {"type": "assistant", "timestamp": ts, "requestId": request, "message": {"model": "m", "content": content, "usage": dict(zip(names, usage))}} | kw


def user(content, ts="2026-01-01T00:00:01.500Z", **kw):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": content}} | kw


def use(i, name="Bash", **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content="", error=False):
    return {"type": "tool_result", "tool_use_id": i, "content": content, "is_error": error}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "-proj/main1.jsonl": [
            {"type": "ai-title", "aiTitle": "t"}, user("please look <system-reminder>x</system-reminder>", cwd="/a"), assistant("r1", [use("t1"), use("t2", "Read", file_path="/f")]), assistant("r1", [{"type": "text", "text": "hi"}], usage=(1, 1, 1, 1)),
            user([result("t1", [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "😀"}]), result("t1", "again"), result("ghost", "boo", True)], toolUseResult={"interrupted": True}), user("[Request interrupted by user]"),
            user("meta", isMeta=True), assistant("r2", [use("open")], ts="2026-01-01T00:01:00Z", usage=(5, 5, 5, 5), cwd="/b", gitBranch="dev"),
        ],
        "-proj/main1/subagents/agent-x.jsonl": [assistant("q", [], isSidechain=True)], "-proj/main1/subagents/workflows/wf_7/agent-y.jsonl": [user([result("z", "")], toolUseResult={"stdout": "out", "stderr": "err"})],
        "-proj/main1/subagents/journal.jsonl": [user("skip")], "-other/s2.jsonl": [user("x")],
    }
    for name, rows in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n{broken")
    (root / "-proj/main1/subagents/agent-x.meta.json").write_text('{"agentType": "scout"}')
    return root


def test_tree(spark, tree):
    lines = X.read_tree(spark, str(tree))
    got = {(r.sid, r.proj, r.kind, r.parent, r.run) for r in lines.select("sid", "proj", "kind", "parent", "run").distinct().collect()}
    assert got == {("main1", "-proj", "main", None, None), ("agent-x", "-proj", "subagent", "main1", None), ("agent-y", "-proj", "workflow-agent", "main1", "wf_7"), ("s2", "-other", "main", None, None)}
    assert X.read_tree(spark, str(tree), ["oth"]).select("sid").distinct().count() == 1
    first = lines.where("sid = 'main1'").orderBy("line_no").first()
    assert first.line_no == 1 and "ai-title" in first.raw
    assert X.read_tree(spark, str(tree), modified_after="2999-01-01T00:00:00").count() == 0


def test_facts(spark, tree):
    lines = X.read_tree(spark, str(tree)).where("sid = 'main1'")
    parsed, blocks = X.parse(lines), X.content_blocks(lines)
    s = X.session_fold(parsed).first()
    assert (s.cwd, s.branch, s.assistant_msgs, s.user_msgs) == ("/a", "dev", 3, 4)
    t = X.session_tokens(X.turns(parsed)).first()
    assert (t.turns, t.in_tokens, t.out_tokens, t.max_ctx, t.first_turn_cache_create) == (2, 15, 25, 80, 40)
    calls = {r.id: r for r in X.call_results(blocks).collect()}
    assert (calls["t1"].dur_sec, calls["t1"].out_chars, calls["t1"].err, calls["t1"].text) == (1.5, 5, False, "a\n\n😀")
    assert (calls["t2"].arg, calls["t2"].out_chars, calls["t2"].dur_sec, calls["t2"].open) == ("/f", 0, None, True)
    assert (calls["ghost"].tool, calls["ghost"].err, calls["ghost"].dur_sec) == ("unknown", True, None)
    msgs = X.user_messages(blocks, F.lit("main")).orderBy("line_no").collect()
    assert [(m.text, m.human) for m in msgs] == [("please look", True), ("[Request interrupted by user]", False), ("meta", False)]
    assert X.interrupts(parsed).first().interrupts == 2
    other = X.content_blocks(X.read_tree(spark, str(tree)).where("sid = 'agent-y'"))
    assert X.call_results(other).first().text == "outerr"


def test_driver_side_reads(spark, tree, tmp_path):
    assert local.session_path(str(tree), "main1").endswith("-proj/main1.jsonl")
    with pytest.raises(LookupError):
        local.session_path(str(tree), "nope")
    subs = local.subagents(spark, str(tree / "-proj/main1.jsonl")).orderBy("id").collect()
    assert [(r.id, r.agent_type) for r in subs] == [("x", "scout"), ("y", None)]
    (tmp_path / "package.json").write_text('{"packageManager": "pnpm@9", "scripts": {"b": "", "a": ""}}')
    (tmp_path / "CLAUDE.md").write_text("x" * 8)
    probe = local.project_probe(spark, [str(tmp_path), "/nowhere"]).collect()
    assert (probe[0].package_manager, probe[0].scripts, probe[0].rules, probe[1].exists) == ("pnpm", ["a", "b"], True, False)
    assert local.context_files(spark, "/nowhere", str(tmp_path)).first().tokens == 2
    (tmp_path / ".env").write_text("# c\nexport A='b c'\nX=1 # n\nbad line\n")
    assert local.env_file(str(tmp_path / ".env")) == {"A": "b c", "X": "1"}
    assert local.resolve_project(str(tree), "other") == "-other"
    assert not local.is_rollout(str(tree / "-other/s2.jsonl"))
    assert local.vaults(spark, str(tree)).count() == 0


def timeline(spark, rows):
    lines = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "sid string, line_no int, raw string")
    return TL.events(lines), TL.turns(X.parse(lines))


@pytest.mark.parametrize("chunk", [50_000, 2])
def test_snapshots(spark, monkeypatch, chunk):
    rows = [
        user("p" * 40), assistant("r1", [{"type": "text", "text": "v" * 40}], usage=(100, 50, 0, 0)), user([result("t", "o" * 80)]), assistant("side", [], usage=(999, 1, 0, 0), isSidechain=True),
        assistant("r2", [], usage=(300, 5, 0, 0)), assistant("r2", [{"type": "text", "text": "w"}], usage=(300, 5, 0, 0)), user("s" * 400, isCompactSummary=True), user("s" * 400, isCompactSummary=True), assistant("r3", [{"type": "text", "text": "x"}], usage=(120, 9, 0, 0)),
    ]
    monkeypatch.setattr(TL, "CHUNK", chunk)
    events, turns = timeline(spark, rows)
    assert [(r.turn, r.ctx) for r in turns.orderBy("turn").collect()] == [(0, 100), (1, 300), (2, 120)]
    shots = {r.turn: r.asDict() for r in TL.snapshots(events, turns).collect()}
    for s in shots.values():
        assert sum(s[k] for k in TL.SHARES) == pytest.approx(s["ctx"]) and all(s[k] >= 0 for k in TL.SHARES)
    assert (shots[0]["prompts"], shots[0]["thinking"], shots[0]["system_tools"]) == (10, 0, 90)
    assert (shots[1]["assistant_text"], shots[1]["thinking"], shots[1]["tool_results"], shots[1]["unattributed"]) == (10, 40, 20, 130)
    assert (shots[2]["thinking"], shots[2]["tool_results"], shots[2]["unattributed"]) == (0, 0, 0)  # emptied, and scaled down to fit
    assert [r.turn for r in TL.compaction_turns(events, turns).collect()] == [2]
    p = TL.peaks(turns).first()
    assert (p.peak_ctx, p.peak_turn, p.final_ctx, p.total_output) == (300, 1, 120, 64)
    z = TL.dumb_zone(turns, window=300, limit=0.4).first()
    assert (z.cross_turn, z.turns_over) == (1, 2)  # 120 of 300 is just over the line
    assert {r.share for r in TL.budget(TL.snapshots(events, turns), TL.peaks(turns)).collect()} == {"system_tools", "prompts", "assistant_text", "thinking", "tool_results", "unattributed"}


def test_attachments(spark):
    rows = [{"type": "attachment", "attachment": a} for a in ({"type": "file", "filename": "x/CLAUDE.md", "content": "abcd"}, {"type": "skill_listing", "skillCount": 3, "content": "s"}, {"type": "deferred_tools_delta", "addedNames": ["a", "b"]}, {"type": "odd"}, {})]
    events, _ = timeline(spark, rows)
    assert [(r.load, r.title) for r in events.orderBy("line_no").collect()] == [("claude-md", "file: CLAUDE.md"), ("skills", "skill_listing (3 skills)"), ("tools", "deferred_tools_delta"), ("other", "odd"), ("other", "attachment")]


def test_second_format(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    usage = lambda **u: {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": u, "model_context_window": 1000}}}
    rows = [
        {"type": "turn_context", "payload": {"model": "m1"}}, item(type="message", role="user", content=[{"text": "hi"}]), item(type="reasoning", content=None), item(type="function_call", name="sh", call_id="c", arguments="{}"),
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}}, usage(input_tokens=50, cached_input_tokens=30, output_tokens=5, reasoning_output_tokens=2), item(type="function_call_output", call_id="c", output="done"), item(type="message", role="assistant", content="bye"),
    ]
    lines = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)], "sid string, line_no int, raw string")
    events, turns = TL.rollout(lines)
    t = turns.collect()
    assert [(r.ctx, r.cache_read, r.output, r.model) for r in t] == [(50, 30, 7, "m1")]
    assert {r.kind: r.request for r in events.collect()} == {"user-prompt": None, "assistant-thinking": "rollout-turn-0", "tool-call": "rollout-turn-0", "tool-result": None, "assistant-text": "rollout-turn-0"}
    assert TL.snapshots(events, turns).count() == 1


def test_command_line(spark, tree, tmp_path, capsys):
    from stratalog import cli

    secret = "ghp_" + "A" * 36
    rows = [
        user("x" * 3_990 + " token " + secret), assistant("r9", [{"type": "tool_use", "id": "b1", "name": "Bash", "input": {"command": "cd /x && pnpm build", "description": "d", "run_in_background": True}}]),
        user([{"type": "tool_result", "tool_use_id": "b1", "is_error": True, "content": "y" * 580 + " " + secret}]),
    ]
    (tree / "-proj/main2.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    assert cli.main(["ingest", str(tree), "--out", str(tmp_path / "facts")]) == 0
    read = lambda n: spark.read.parquet(str(tmp_path / f"facts/{n}.parquet"))
    assert spark.read.json(str(tmp_path / "facts/json/tool_rows")).count() == read("tool_rows").count() == 6
    b = read("bash_rows").where("sid = 'main2'").first()
    assert (b.cmd, b.family, b.bin, b["desc"], b.bg, b.err, b.outChars) == ("cd /x && pnpm build", "pnpm build", "pnpm", "d", True, True, 621)
    e = read("error_rows").where("sid = 'main2'").first()
    assert (e.tool, e.msg) == ("Bash", "y" * 580 + " [REDACTED]") and b.out == e.msg
    assert not read("user_msg_rows").where("sid = 'main2' and text like '%ghp%'").count() and read("user_msg_rows").where("sid = 'main2'").first().text.startswith("xxx")
    m = read("session_rows").where("sid = 'main1'").first()
    assert (m.proj, m.kind, m.assistantMsgs, m.userMsgs, m.inTokens, m.maxCtx, m.interrupts) == ("-proj", "main", 3, 4, 15, 80, 2) and sum(m.models.values()) == 2
    assert cli.main(["report", str(tree), "--format", "json", "--out", str(tmp_path / "r.json")]) == 0
    got = json.loads((tmp_path / "r.json").read_text())
    assert [c["top_tool"] for c in got["err_clusters"] if c["sig"].startswith("yyy")] == ["Bash"] and got["window_section"][0]["files"] == 5
    assert cli.main(["session", str(tree), "main1", "--out", str(tmp_path / "s.html")]) == 0
    assert "<svg" in (tmp_path / "s.html").read_text()


def test_window_drops_old_sessions(spark, tree):
    old = {"type": "user", "timestamp": "2001-01-01T00:00:00Z", "message": {"content": "old"}}
    (tree / "-other/old.jsonl").write_text(json.dumps(old))
    facts = X.tree_facts(spark, str(tree), since="2002-01-01T00:00:00")
    assert facts["session_rows"].where("sid = 'old'").count() == 0 == facts["user_msg_rows"].where("sid = 'old'").count()
    assert X.tree_facts(spark, str(tree))["session_rows"].where("sid = 'old'").count() == 1
