"""Sinks and charts."""

import json

from pyspark.sql import functions as F

from stratalog.operators import assets as A
from stratalog.operators import events as E
from stratalog.render import sinks, svg


def test_markdown():
    rows = [{"a": "x|y\nz", "n": 1.5}] * 30
    text = sinks.md_table(rows)
    assert "x\\|y z" in text and "5 more not shown" in text and sinks.md_table([]) == "(none)"
    assert len(sinks.cell("x" * 100)) == 70


def test_json_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "k string, v int")
    assert json.loads(sinks.report_json({"part": df}))["part"] == [{"k": "a"}]
    assert "## part" in sinks.report_md("T", {"part": df})
    f = df.select(F.lit("v").alias("vault"), F.lit("IDX01").alias("check"), F.lit("med").alias("severity"), F.lit("n").alias("note"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("evidence"))
    got = json.loads(sinks.findings_json(f))
    assert got["severityCounts"] == {"critical": 0, "high": 0, "med": 1, "low": 0} and list(got["findings"][0]) == ["vault", "check", "severity", "note"]
    sinks.write_facts({"t": df}, str(tmp_path))
    assert spark.read.text(str(tmp_path / "json/t")).first()[0] == '{"k":"a"}'


def test_charts():
    turns = [{"ctx": 10, "a": 4, "b": 6}, {"ctx": 20, "a": 5, "b": 15}]
    assert svg.timeline(turns, ["a", "b"], 100, 0.4, [1]).count("<polygon") == 2
    assert svg.timeline([], ["a"], 100, 0.4).startswith("<svg")
    assert svg.donut([("x", 1), ("y", 0)]).count("<circle") == 1
    assert svg.arcs([{"slug": "a", "bytes": 1}, {"slug": "b", "bytes": 4}], [("a", "b"), ("a", "a"), ("a", "gone")]).count("<path") == 1
    assert "</script>" not in sinks.page("t", [], {"x": "</script>"}).split('id="data">')[1][:-len("</script></body></html>")]


def test_assets(spark):
    df = spark.createDataFrame([("1", "", "A.png", "public"), ("2", "x", "b.png", "private")], "id string, folder string, filename string, visibility string")
    assert [r.id for r in A.select(df, folder="").collect()] == ["1"]
    assert A.resolve(df, "a.P")["id"] == "1" and A.resolve(df, "2")["id"] == "2"
    for wanted in (".png", "zzz"):
        try:
            A.resolve(df, wanted)
        except LookupError:
            continue
        raise AssertionError(wanted)


def test_sampling(spark):
    df = spark.range(10_000).withColumn("bad", F.col("id") % 100 == 0)
    kept = df.where(E.keep(F.col("id"), F.col("bad"), 10)).withColumn("w", E.weight(F.col("bad"), 10))
    assert kept.where("bad").count() == 100 and abs(kept.agg(F.sum("w")).first()[0] - 10_000) < 1_000
    assert {r.id for r in kept.collect()} == {r.id for r in df.where(E.keep(F.col("id"), F.col("bad"), 10)).collect()}
