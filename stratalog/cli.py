"""Command line: fleet audit, session report, vault audit."""

from __future__ import annotations

import argparse
import shutil
import uuid
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalog.functions import redaction
from stratalog.operators import timeline as TL
from stratalog.operators import vault as V
from stratalog.plans import fleet, people
from stratalog.render import pages, sinks
from stratalog.sources import local
from stratalog.sources import transcripts as X
from stratalog.sources.tables import shared_folder

FLEET = [*fleet.QUERIES, *(n for n in people.QUERIES if n.startswith("human_"))]
#: What JSON copies of the tables are ordered by.
ORDER = {"session_rows": ["file"], **{n: ["sid", "t", "row_id"] for n in ("tool_rows", "bash_rows", "user_msg_rows", "error_rows")}}


def spark_session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def ingest(spark: SparkSession, a: argparse.Namespace, out: str) -> None:
    """A transcript tree into fact tables below `out`; texts are redacted first and clipped then."""
    since = (datetime.now(timezone.utc) - timedelta(days=a.days)).strftime("%Y-%m-%dT%H:%M:%S") if a.days else None
    clean = (lambda c: c) if a.no_redact else redaction.redact_udf()
    sinks.write_facts(X.tree_facts(spark, a.root, a.project, since, clean), out, ORDER)


def report(spark: SparkSession, a: argparse.Namespace) -> str:
    """The fleet report over fact tables, or over a transcript tree that is read into such first."""
    tables = a.root
    if not Path(a.root, "tool_rows.parquet").exists() and "://" not in a.root:
        tables = a.tables or str(Path(shared_folder(spark).removeprefix("file:"), f"facts-{uuid.uuid4().hex}"))
        ingest(spark, a, tables)
    every = {**fleet.QUERIES, **people.QUERIES}
    sections = {n: every[n](spark, tables) for n in FLEET}
    text = sinks.report_json(sections) if a.format == "json" else sinks.report_md("Fleet report", sections)
    if tables not in (a.root, a.tables):
        shutil.rmtree(tables)
    return text


def vault(spark: SparkSession, a: argparse.Namespace) -> str:
    """Findings of vaults, or one of the things that can be done with them."""
    if a.snapshot:
        return sinks.snapshot(a.root, a.snapshot, datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S"))
    if a.undo:
        return sinks.undo(a.root, a.undo)
    files = V.read_vaults(spark, a.root)
    md = files.where(F.lower("file").endswith(".md") & (F.col("file") != V.INDEX)).withColumn("slug", F.regexp_replace("file", r"(?i)\.md$", ""))
    notes, entries = V.notes(md, "vault", "slug", "slug", "text"), V.index_entries(files.where(F.col("file") == V.INDEX).select("vault", "text"))
    if a.reindex:
        states = V.states(files.where(F.col("file") == V.INDEX).select("vault", "text"), entries, notes)
        return "\n".join(sinks.write_index(V.reindex(entries, notes), a.reindex, states))
    if a.all:
        return pages.all_vaults_page(md.groupBy("vault").agg(F.count("*").alias("notes"), F.sum("bytes").alias("bytes"), F.countDistinct("slug").alias("slugs")))
    found = V.with_severity(V.audit(files))
    if a.validate:
        found = V.acceptable(found)
    if a.view:
        return pages.vault_page(a.view, notes, V.resolve(V.links(notes), notes), found)
    return sinks.findings_json(V.ordered(V.at_least(found, a.severity)))


def session(spark: SparkSession, a: argparse.Namespace) -> str:
    path = local.session_path(a.root, a.sid)
    sid = path.rpartition("/")[2].removesuffix(".jsonl")
    lines = X.read_tree(spark, a.root).where(F.col("sid") == sid)
    events, turns = TL.rollout(lines) if local.is_rollout(path) else (TL.events(lines), TL.turns(X.parse(lines), own_window=sid.startswith("agent-")))
    clean = (lambda c: c) if a.no_redact else redaction.redact_udf(redaction.LABELLED)
    return pages.session_page(sid, events.withColumns({c: clean(c) for c in ("title", "body")}), turns, a.window, a.limit, local.subagents(spark, path))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratalog", description=__doc__)
    sub = p.add_subparsers(dest="mode", required=True)
    f = sub.add_parser("report", help="fleet report over a transcript tree or over fact tables")
    f.add_argument("--format", choices=["md", "json"], default="md")
    f.add_argument("--tables", help="folder in which a tree's fact tables are kept")
    i = sub.add_parser("ingest", help="transcript tree into fact tables")
    s = sub.add_parser("session", help="HTML report of one session")
    v = sub.add_parser("vault", help="audit, view, reindex, snapshot or undo of note vaults")
    for c in (f, i, s, v):
        c.add_argument("root")
        c.add_argument("--out", required=c is i, help="file (ingest: folder) to write; else the result is printed")
    for c in (f, i):
        c.add_argument("--project", action="append")
        c.add_argument("--days", type=int)
    for c in (f, i, s):
        c.add_argument("--no-redact", action="store_true")
    s.add_argument("sid")
    s.add_argument("--window", type=int, default=TL.WINDOW)
    s.add_argument("--limit", type=float, default=TL.LIMIT)
    v.add_argument("--severity", choices=V.RANKS, default="low")
    v.add_argument("--view", metavar="VAULT", help="one vault's page")
    v.add_argument("--all", action="store_true", help="a page of all vaults")
    v.add_argument("--validate", action="store_true", help="only findings that a repaired vault may not have")
    v.add_argument("--reindex", metavar="FOLDER", help="write new index files below FOLDER")
    v.add_argument("--snapshot", metavar="BACKUPS")
    v.add_argument("--undo", metavar="BACKUPS")
    a = p.parse_args(argv)
    spark = spark_session(f"stratalog {a.mode}")
    if a.mode == "ingest":
        ingest(spark, a, a.out)
        return 0
    text = {"report": report, "session": session, "vault": vault}[a.mode](spark, a)
    Path(a.out).write_text(text) if a.out else print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
