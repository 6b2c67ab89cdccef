"""Drift, skew, orphans and nesting on small literal tables, with the awkward cases."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalog.operators import drift, lines, nested, orphans, skew

LINES = "line_id bigint, sid string, line_no int, raw string, ingested_at timestamp, tag string, n int"
CONTRACT = "line_type string, path string, json_types string, required boolean"


def raw(spark, *rows, sid="s"):
    data = [(i, sid if isinstance(r, str) or r is None else r[0], i, r if isinstance(r, str) or r is None else r[1], None, "clash", 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LINES).withColumn("ingested_at", F.to_timestamp(F.lit("2026-03-05")))


def contract(spark):
    rows = [
        ("user", "type", "string", True), ("user", "cwd", "string", True), ("user", "n", "number", True), ("user", "message", "object", True), ("user", "message.content", "string|array", True),
        ("user", "message.usage", "object", False), ("user", "message.usage.in", "number", True), ("note", "type", "string", True),
    ]
    return spark.createDataFrame(rows, CONTRACT)


def line(**kw):
    return json.dumps({"type": "user", "cwd": "/a/b", "n": 1, "message": {"content": "x"}} | kw)


def without(key, **kw):
    o = json.loads(line(**kw))
    del o[key]
    return json.dumps(o)


def test_changes(spark):
    rows = [
        ("ok", line()), ("null", line(cwd=None, extra=None)), ("added", line(extra={"deep": 1})), ("retyped", line(n="7", message="gone")), ("removed", without("cwd")), ("renamed", without("cwd", workdir="/a/c")),
        ("renamed", without("cwd", workdir="/d/c")), ("inner", line(message={"content": [{"odd": 1}], "usage": {"out": 1}})), ("typed", without("type", lineType="user")), ("object", line(type={"name": "user"})),
        ("blank", ""), ("broken", line()[:-3]), ("broken", "[1]"), ("unknown", '{"type": "other"}'), ("none", None),
    ]
    got = {tuple(r) for r in drift.changes(raw(spark, *rows), contract(spark)).collect()}
    assert got == {
        ("added", "user", "extra", "added"), ("retyped", "user", "n", "retyped"), ("retyped", "user", "message", "retyped"), ("removed", "user", "cwd", "removed"), ("renamed", "user", "cwd", "renamed"),
        ("inner", "user", "message.usage.in", "removed"), ("inner", "user", "message.usage.out", "added"), ("typed", "user", "type", "renamed"), ("object", "user", "type", "retyped"),
    }


def test_changes_of_nothing(spark):
    assert drift.changes(raw(spark, line()).where("false"), contract(spark)).count() == 0
    assert drift.changes(raw(spark, line()), contract(spark).where("false")).count() == 0


def test_landing_converts_and_keeps(spark):
    got = drift.land(raw(spark, line(n="7"), line(n={"total": 3}), line(n="x"), line(n=True), line()), contract(spark)).orderBy("line_id").collect()
    assert [r.fields["n"].value for r in got] == ["7", "3", None, None, "1"]
    assert got[0].branches["n"].asDict() == {"json_type": "string", "value": "7"} and got[4].branches == {}


def test_landing_loses_nothing(spark):
    pairs = spark.createDataFrame([("user", "cwd", "work_cwd", 1.0), ("user", "cwd", "dir", 0.9)], "line_type string, old string, new string, score double")
    rows = [
        line(extra={"deep": [1]}), line(work_cwd="/other"), without("cwd", work_cwd="/b", dir="/c"), '{"type": "strange", "x": 1, "y": null}', line(cwd=None), line(message={}), line(**{"message.usage.in": 9}), "{}", "[1]", "",
    ]
    df = raw(spark, *rows).withColumn("line_id", F.when(F.col("line_id") < 4, F.col("line_id")))
    got = {r.line_no: r for r in drift.land(df.unionByName(df.where("line_id = 0")), contract(spark), pairs).collect()}
    assert sorted(got) == list(range(8))  # null ids don't collapse, a repeated one does
    assert got[0].branches["extra"].asDict() == {"json_type": "object", "value": '{"deep":[1]}'}
    assert got[1].fields["cwd"].value == "/a/b" and got[1].branches["work_cwd"].value == "/other"
    assert (got[2].fields["cwd"].value, got[2].fields["cwd"].how) == ("/b", "renamed") and set(got[2].branches) == {"work_cwd", "dir"}
    assert got[3].line_type is None and {p: b.json_type for p, b in got[3].branches.items()} == {"type": "string", "x": "number", "y": "null"}
    assert got[4].fields["cwd"].json_type == "null" and got[5].fields["message"].value == "{}" and set(got[6].branches) == {"message\\.usage\\.in"}
    flat = drift.wide(drift.land(df, contract(spark), pairs), contract(spark)).where("line_no = 2").first()
    assert (flat.cwd, flat.n, flat.message__content) == ("/b", 1.0, "x") and "work_cwd" in flat._rest


def test_union_keeps_all_types_of_a_path(spark):
    df = raw(spark, ("a", line(n="7")), ("a", line(n=1)), ("b", line(n=None)), ("b", line(n=2, new=[1])), ("c", '{"type": "other"}'), ("c", "broken"))
    found = drift.alternatives(df.unionByName(df), contract(spark))
    got = {(r.line_type, r.path, r.json_type, r.agreed, r.n_lines, r.n_files) for r in drift.union(found).where("path in ('n', 'new', 'type')").collect()}
    assert got == {
        ("user", "n", "string", False, 1, 1), ("user", "n", "number", True, 2, 2), ("user", "n", "null", True, 1, 1), ("user", "new", "array", False, 1, 1), ("user", "type", "string", True, 4, 2),
        (None, "type", "string", False, 1, 1),
    }
    assert drift.alternatives(df.where("false"), contract(spark)).count() == 0


def test_a_long_line(spark):
    got = drift.changes(raw(spark, line(extra="x" * 2_000_000)), contract(spark)).collect()
    assert [r.change for r in got] == ["added"]


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, tool string, err boolean, ms bigint, n int, key_value string")


def test_per_key_counts_each_row_once(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.random() < 0.3, rng.choice([1, 5, None]), 0, "x") for i in range(3000)]
    df = table(spark, rows + rng.choices(rows, k=500))
    got = {r.key_value: (r.n, r.errors, r.ms) for r in skew.per_key(df, "tool", "row_id", {"errors": F.col("err").cast("int"), "ms": F.col("ms")}, partitions=7).collect()}
    want = {}
    for _, k, e, ms, *_ in rows:
        n, errors, total = want.get(k, (0, 0, 0))
        want[k] = (n + 1, errors + e, total + (ms or 0))
    assert got == want
    parts = skew.partials(df, "tool", "row_id", {}, 7).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 3 * len(rows) / 7  # the hot key is cut


def test_heavy_keys(spark):
    df = table(spark, [(i, "a" if i < 5 else f"k{i}", False, 1, 0, "") for i in range(100)] + [(200, None, False, 1, 0, "")] * 3)
    assert {r.key_value for r in skew.heavy_keys(df, "tool", "row_id", 0.045).collect()} == {"a"}
    assert skew.heavy_keys(df, "tool", "row_id", 0.05).count() == 0  # 5 of 101
    assert skew.heavy_keys(df.where("false"), "tool", "row_id", 0.05).count() == 0


def block_line(content, **kw):
    return json.dumps({"type": "user", "message": {"content": content}} | kw)


def test_children(spark):
    deep = {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "x"}, "bare", {"type": "image", "content": [{"type": "text"}]}]}
    df = raw(spark, block_line([deep, "top", {"no": "type"}]), block_line("plain", toolUseResult={}), '{"message": {"usage": {}, "content": null}, "toolUseResult": "text"}', "", "{", None, block_line([]))
    got = sorted(tuple(r) for r in nested.children(df.unionByName(df)).collect())
    assert got == sorted([
        (0, "0", "", "tool_result"), (0, "0.0", "0", "text"), (0, "0.1", "0", "text"), (0, "0.2", "0", "image"), (0, "0.2.0", "0.2", "text"), (0, "1", "", "text"), (0, "2", "", ""),
        (1, "0", "", "text"), (1, "toolUseResult", "", "toolUseResult"), (2, "usage", "", "usage"),
    ])


def test_flat_tables(spark, tmp_path):
    df = raw(spark, json.dumps({"type": "assistant", "message": {"usage": {"input_tokens": 3, "output_tokens": "odd"}, "content": [{"type": "tool_use", "id": "i", "name": "Read", "input": {"b": 1, "a": 2}}]}}))
    tagged = nested.flatten(df)
    assert nested.flat_table(tagged, "usage").select("input_tokens", "output_tokens").first() == (3, None)
    assert nested.flat_table(tagged, "block").select("id", "name").first() == ("i", "Read")
    nested.write_flat(tagged, str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).where("tag = 'line'").count() == 1


def test_no_depth_is_too_much(spark):
    given = '{"a":[' * 20_000 + "]}" * 20_000
    df = raw(spark, '{"type":"user","message":{"usage":{"input_tokens":1},"content":[{"type":"tool_use","input":' + given + '}]},"extra":' + given + "}")
    assert nested.children(df).count() == 2
    assert nested.flatten(df).where("tag = 'block'").select(F.length("payload")).first()[0] > len(given)
    assert drift.facts(df, drift.Contract(contract(spark))).count() > 0
    blocks = raw(spark, '{"message":{"content":[' + '{"type":"x","content":[' * 1_500 + '"end"' + "]}" * 1_500 + "]}}")
    assert nested.children(blocks).count() == 1_501
    for text in ('{"a":[1,2,{"b":[]}],"c":{},"d":"\\u00e9\\""}', "[]", " [1 , 2] ", '"x"'):
        assert lines._deep(text) == json.loads(text) and lines._deep_dumps(json.loads(text), {"indent": 2, "ensure_ascii": False}, 2) == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    for text in ("{", "[1,]", '{"a":1,}', '{"a"}', "{1:2}", "[1 2]", '{"a":1}}', "[}", "{]", "", "01", "[:]", '{"a",1}'):
        with pytest.raises(ValueError):
            lines._deep(text)


def test_deep_nesting(spark):
    block = {"type": "text"}
    for _ in range(300):
        block = {"type": "x", "content": [block]}
    assert nested.children(raw(spark, block_line([block]))).count() == 301
    assert lines.parse("[" * 100_000) is None


def test_orphans(spark):
    use, result = (lambda i: {"type": "tool_use", "id": i}), (lambda i: {"type": "tool_result", "tool_use_id": i})
    text = raw(spark, ("s1", block_line([result("late"), result("never"), result("other")])), ("s1", block_line([{"type": "x", "content": [use("late")]}])), ("s2", block_line([use("other")])), ("lost", "broken"), (None, "{}"))
    sessions = spark.createDataFrame([("s1", None), ("s2", "s1"), ("s3", "nobody"), (None, "nobody"), ("", "")], "sid string, parent string").withColumn("ingested_at", F.to_timestamp(F.lit("2026-04-01")))
    facts = {"tool_rows": spark.createDataFrame([("s1",), ("gone",), ("gone",), (None,), ("S1",)], "sid string").withColumn("ingested_at", F.to_timestamp(F.lit("2026-02-01")))}
    got = {tuple(r) for r in orphans.find_orphans(text, sessions, facts).collect()}
    assert got == {
        ("tool_result", "s1", "never", "2026-03"), ("tool_result", "s1", "other", "2026-03"), ("tool_rows", "gone", "gone", "2026-02"), ("tool_rows", "S1", "S1", "2026-02"),
        ("transcript_lines", "lost", "lost", "2026-03"), ("session_rows", "s3", "nobody", "2026-04"),
    }
    assert orphans.find_orphans(text.where("false"), sessions.where("false"), {"tool_rows": facts["tool_rows"].where("false")}).count() == 0


def test_many_orphans_over_several_bitmaps(spark):
    sessions = spark.range(0, 90_000, 2).select(F.col("id").cast("string").alias("sid"), F.lit(None).cast("string").alias("parent"), F.to_timestamp(F.lit("2026-01-01")).alias("ingested_at"))
    rows = spark.range(90_000).select(F.col("id").cast("string").alias("sid"), F.to_timestamp(F.lit("2026-01-01")).alias("ingested_at"))
    got = orphans.find_orphans(raw(spark, "").where("false"), sessions, {"tool_rows": rows})
    assert got.count() == 45_000 and got.where("cast(ref as int) % 2 = 0").count() == 0


@pytest.mark.parametrize(("a", "b", "least"), [("sessionId", "session_id", 0.9), ("stdout", "stdoutText", 0.4), ("cwd", "entrypoint", 0)])
def test_name_likeness(a, b, least):
    assert (drift.name_likeness(a, b) >= least) if least else drift.name_likeness(a, b) == 0


def test_visit_order_is_depth_first():
    kinds = [p for p, *_ in lines.blocks([{"content": [{"content": ["x"]}, "y"]}, "z"])]
    assert kinds == ["0", "0.0", "0.0.0", "0.1", "1"]
    assert Counter(k for _, _, k, _ in lines.blocks([None, 3, {"type": 5}])) == {"": 2, "5": 1}
