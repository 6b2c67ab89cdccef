"""Vaults of linked notes: parsing, link graph, index, rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions import frontmatter
from stratalog.functions import text as T
from stratalog.functions.redaction import first_secret_line, redact

INDEX, MOST_LINES, MOST_BYTES = "MEMORY.md", 200, 25 * 1024
FENCED = r"(?s)\A\x{FEFF}?[ \t]*---[ \t]*\r?\n(?:.*?\r?\n)??[ \t]*---[ \t]*(?:\r?\n|\z)"
#: Valid note types, required fields, and the rules' severities.
TYPES, REQUIRED = ["user", "feedback", "project", "reference"], ["name", "description", "type"]
SEVERITY = {
    "IDX01": "med", "IDX02": "high", "IDX04": "high", "IDX05": "high", "IDX07": "low", "IDX08": "low", "IDX09": "low", "IDX10": "low", "IDX11": "med", "IDX12": "low", "LNK01": "low", "LNK02": "low", "LNK03": "low",
    "LNK04": "low", "SCH01": "med", "SCH02": "med", "SCH03": "med", "SCH08": "low", "SCH09": "med", "HYG01": "low", "HYG04": "low", "HYG05": "low", "STA01": "med", "DUP01": "med", "SEC01": "critical",
}
RANKS = ["critical", "high", "med", "low"]
HAS_WHY = r"(?im)(\*\*\s*Why\s*:?\s*\*\*|^\s*Why\s*:)"
HAS_HOW = r"(?im)\*\*\s*How to apply\b[^*\n]*\*\*|^\s*How to apply\b[^:\n]*:"
PLACEHOLDER = r"\b(?:TODO|FIXME|XXX)\b|[Ll]orem [Ii]psum"
RELATIVE = r"(?i)\b(?:yesterday|today|last week|this week|as of (?:today|now))\b"


def read_vaults(spark: SparkSession, root: str) -> DataFrame:
    """(vault, file, text, bytes, mtime) of every file below `root`, the vault being the folder a file is in.

    Notes are small; a file is one row. Names that begin with `_` or `.` are skipped by Spark's listing.
    """
    meta = F.col("_metadata")
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    parts = F.split(F.url_decode(F.regexp_replace(meta["file_path"], r"\+", "%2B")), "/")
    return files.select(F.element_at(parts, -2).alias("vault"), F.element_at(parts, -1).alias("file"), F.col("value").alias("text"), meta["file_size"].alias("bytes"), meta["file_modification_time"].alias("mtime"))


def body(text: Column) -> Column:
    """A note's text below its front matter; CRLF there becomes LF, as the parser joins lines anew."""
    return F.when(text.rlike(FENCED), F.replace(F.regexp_replace(text, FENCED, ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\x{FEFF}", ""))


def notes(df: DataFrame, vault: str, note: str, slug: str, text: str) -> DataFrame:
    """(vault, note, slug, front matter fields, body and measures of each note)."""
    fm = F.pandas_udf(frontmatter.parse_all, frontmatter.SCHEMA)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(vault).alias("vault"), F.col(note).alias("note"), F.col(slug).alias("slug"), t.alias("text")).withColumn("fm", fm("text")).select("vault", "note", "slug", "text", "fm.*")
    lines = F.split("text", r"\r?\n")
    return rows.withColumns({
        "bytes": F.octet_length("text"), "lines": F.size(lines), "max_line": F.array_max(F.transform(lines, T.length16)), "body_hash": T.body_hash(F.col("body")),
        "has_why": F.col("body").rlike(HAS_WHY), "has_how": F.col("body").rlike(HAS_HOW),
    })


def numbered(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """A row a line, numbered from 1."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("_at", "row")).withColumn("line", F.col("_at") + 1).drop("_at")


def links(note_rows: DataFrame) -> DataFrame:
    """(vault, note, slug, line, kind, target): wiki and markdown links of note bodies, in lower-case slugs."""
    rows = numbered(note_rows, F.col("body"), ["vault", "note", "slug"])
    wiki, mark = T.wiki_and_markdown_links(F.col("row"))
    found = F.concat(F.transform(wiki, lambda t: F.struct(F.lit("wiki").alias("kind"), t.alias("raw"))), F.transform(mark, lambda t: F.struct(F.lit("markdown").alias("kind"), t.alias("raw"))))
    return rows.where(F.contains("row", F.lit("["))).select("vault", "note", "slug", "line", F.explode(found).alias("l")).select("vault", "note", "slug", "line", "l.kind", T.normalize_slug(F.col("l.raw")).alias("target"))


def link_targets(body: Column) -> Column:
    """The distinct targets of a body's links, as `links` has them, without a row a link."""
    rows = F.filter(F.split(body, "\n"), lambda row: F.contains(row, F.lit("[")))
    raw = F.flatten(F.transform(rows, lambda row: F.concat(*T.wiki_and_markdown_links(row))))
    return F.array_distinct(F.transform(raw, T.normalize_slug))


def resolve(link_rows: DataFrame, note_rows: DataFrame) -> DataFrame:
    """Links with `hits`, the notes of that slug in the vault, and `to`, the first of them."""
    by_slug = note_rows.where("slug is not null").groupBy("vault", F.lower("slug").alias("target")).agg(F.count("*").alias("hits"), F.min("note").alias("to"))
    return link_rows.join(by_slug, ["vault", "target"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


#: Characters of the piece by which containment meets.
GRAM = 4


def _pieces(c: str, edits: int = 2) -> Column:
    """Keys of a word: itself in `edits` + 1 even pieces; a word so many edits away keeps one of them."""
    n = F.length(c)
    return F.array(*[F.concat_ws("/", n, F.lit(i), F.substring(F.col(c), 1 + F.floor(n * i / (edits + 1)).cast("int"), (F.floor(n * (i + 1) / (edits + 1)) - F.floor(n * i / (edits + 1))).cast("int"))) for i in range(edits + 1)])


def _windows(c: str, edits: int = 2) -> Column:
    """Keys of a word: where the pieces of words so many edits away may stand in it. Of several pieces that are kept one is met within these shifts."""
    keys = []
    for more in range(-edits, edits + 1):
        n = F.length(c) - more  # of the other word
        for i in range(edits + 1):
            begin, size = F.floor(n * i / (edits + 1)).cast("int"), (F.floor(n * (i + 1) / (edits + 1)) - F.floor(n * i / (edits + 1))).cast("int")
            for shift in range(max(-i, more - (edits - i)), min(i, more + (edits - i)) + 1):
                fits = (n >= 0) & (begin + shift >= 0) & (begin + shift + size <= F.length(c))
                keys.append(F.when(fits, F.concat_ws("/", n, F.lit(i), F.substring(F.col(c), begin + shift + 1, size))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _grams(c: str) -> Column:
    """All pieces of a word of 1 to GRAM characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.flatten(F.array(*[F.transform(F.filter(at, lambda i: i + (k - 1) <= F.length(c)), lambda i: F.substring(F.col(c), i, F.lit(k))) for k in range(1, GRAM + 1)])))


def near_matches(targets: DataFrame, slugs: DataFrame) -> DataFrame:
    """(vault, target, slug, distance): slugs that contain the target, lie in it, or are at most two edits away.

    targets (vault, target), slugs (vault, slug), both distinct and in lower case. No cross join: what is contained meets on its first GRAM characters; of a word in three pieces
    one is left after two edits, at one of a few places. Keys of a word are linear in its length, and merge joins keep them from a broadcast: their number
    isn't in the planner's estimate, which is that of the words.
    """
    t, s = targets.select("vault", "target"), slugs.select("vault", "slug")

    def met(x: DataFrame, y: DataFrame, by_x: Column, by_y: Column, when: Column) -> DataFrame:
        x, y = x.withColumn("h", F.explode(by_x)), y.withColumn("h", F.explode(by_y))
        return x.hint("merge").join(y.hint("merge"), ["vault", "h"]).where(when).select("vault", "target", "slug")

    first = lambda c: F.array(F.substring(F.col(c), 1, GRAM))
    inside = met(t, s, _grams("target"), first("slug"), F.contains("target", F.col("slug")))
    around = met(t, s, first("target"), _grams("slug"), F.contains("slug", F.col("target")))
    close = met(t, s, _pieces("target"), _windows("slug"), F.levenshtein("target", "slug") <= 2)
    return inside.unionByName(around).unionByName(close).distinct().withColumn("distance", T.edit_distance(F.col("target"), F.col("slug")))


def degrees(note_rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """(vault, note, out_degree, in_degree): a link to itself counts as going out only."""
    hit = resolved.where("hits > 0")
    out = hit.groupBy("vault", "note").agg(F.count("*").alias("out_degree"))
    into = hit.where("note <> to").groupBy("vault", F.col("to").alias("note")).agg(F.count("*").alias("in_degree"))
    return note_rows.select("vault", "note").join(out, ["vault", "note"], "left").join(into, ["vault", "note"], "left").fillna(0, ["out_degree", "in_degree"])


SEP = r"(?:—|–|·|-{1,2})"
MD_ENTRY = rf"^\s*[-*]\s+\[([^\]]+)\]\(([^)]+)\)\s*(?:{SEP}\s*(.*))?$"
WIKI_ENTRY = rf"^\s*[-*]\s+\[\[([^\]]+)\]\]\s*(?:{SEP}\s*(.*))?$"


def index_entries(index: DataFrame) -> DataFrame:
    """Entries of index texts (vault, text): bullets with line number, kind, label, target, hook, byte offset; other lines are none.

    below_fold: past the line budget, or starting past the byte budget.
    """
    rows = numbered(index, F.regexp_replace("text", r"\r\n", "\n"), ["vault"]).withColumn("size", F.octet_length("row") + 1)
    before = Window.partitionBy("vault").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    md, wiki = F.col("row").rlike(MD_ENTRY), F.col("row").rlike(WIKI_ENTRY)
    kind = F.when(md, "markdown").when(wiki, "wiki").when(F.col("row").rlike(r"^\s*[-*]\s+\S"), "bare")
    label = F.when(md, F.regexp_extract("row", MD_ENTRY, 1)).when(wiki, F.regexp_extract("row", WIKI_ENTRY, 1))
    target = F.when(md, F.regexp_extract("row", MD_ENTRY, 2)).when(wiki, F.regexp_extract("row", WIKI_ENTRY, 1))
    hook = F.when(md, F.regexp_extract("row", MD_ENTRY, 3)).when(wiki, F.regexp_extract("row", WIKI_ENTRY, 2))
    return rows.withColumn("kind", kind).where("kind is not null").select(
        "vault", "line", "row", "kind", F.trim(label).alias("label"), T.normalize_slug(target).alias("target"), F.nullif(F.trim(hook), F.lit("")).alias("hook"), "offset",
        ((F.col("line") > MOST_LINES) | (F.col("offset") >= MOST_BYTES)).alias("below_fold"),
    )


def states(index: DataFrame, entries: DataFrame, note_rows: DataFrame) -> DataFrame:
    """(vault, state, lines, bytes, over_budget): ok, empty, or monolithic when the index is prose with headings and no entry."""
    size = index.select("vault", F.octet_length("text").alias("bytes"), F.size(F.split("text", r"\r?\n")).alias("lines"), (F.col("text").rlike(r"(^|\n)#{1,6}\s") & (F.trim("text") != "")).alias("prose"))
    n = entries.where("target is not null").groupBy("vault").agg(F.count("*").alias("entries"))
    files = note_rows.groupBy("vault").agg(F.count("*").alias("notes"))
    all_ = size.join(n, "vault", "left").join(files, "vault", "full_outer").fillna(0, ["entries", "notes", "lines", "bytes"])
    mono = F.coalesce("prose", F.lit(False)) & (F.col("entries") == 0)
    state = F.when(mono, "monolithic").when((F.col("notes") == 0) & (F.col("entries") == 0), "empty").otherwise("ok")
    return all_.select("vault", state.alias("state"), "lines", "bytes", ((F.col("lines") > MOST_LINES) | (F.col("bytes") > MOST_BYTES)).alias("over_budget"))


def reindex(entries: DataFrame, note_rows: DataFrame) -> DataFrame:
    """(vault, ord, entry): the canonical index: entries of existing notes in their order with label and hook kept, then new notes by slug."""
    have = note_rows.where("slug is not null").groupBy("vault", F.lower("slug").alias("target")).agg(F.min("slug").alias("slug"), F.min_by("name", "note").alias("name"), F.min_by("description", "note").alias("description"))
    first = entries.where("target is not null").groupBy("vault", "target").agg(F.min("line").alias("line"), F.min_by("label", "line").alias("label"), F.min_by("hook", "line").alias("hook"))
    rows = have.join(first, ["vault", "target"], "left")
    hook = F.coalesce("hook", F.nullif(F.col("description"), F.lit("")))
    text = F.concat(F.lit("- ["), F.coalesce("label", F.nullif(F.col("name"), F.lit("")), "slug"), F.lit("]("), F.col("slug"), F.lit(".md)"), F.coalesce(F.concat(F.lit(" — "), hook), F.lit("")))
    order = Window.partitionBy("vault").orderBy(F.col("line").asc_nulls_last(), "slug")
    return rows.select("vault", F.row_number().over(order).alias("ord"), text.alias("entry"))


FINDING = ["vault", "check", "note", "line", "evidence"]


def _found(df: DataFrame, check: str, note: Column | str | None = "note", line: Column | str | None = None, evidence: Column | str | None = None) -> DataFrame:
    col = lambda c, t: (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(t)
    return df.select("vault", F.lit(check).alias("check"), col(note, "string").alias("note"), col(line, "int").alias("line"), col(evidence, "string").alias("evidence"))


def note_rules(n: DataFrame) -> DataFrame:
    """Findings that a note shows by itself: schema, hygiene, staleness, naming. All rules in one pass: an array of findings a row, exploded."""
    def rule(check: str, when: Column, line: Column | None = None, evidence: Column | None = None) -> Column:
        e = F.lit(None).cast("string") if evidence is None else evidence
        return F.when(when, F.struct(F.lit(check).alias("check"), (F.lit(None) if line is None else line).cast("int").alias("line"), e.alias("evidence")))

    lines = F.split("body", "\n")
    none = F.col("shape") == "none"
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = F.array_join(F.filter(F.array(*[F.when(empty(c), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()), ", ")

    def at(pattern: str) -> Column:
        return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)

    h1 = F.trim(F.regexp_replace(F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^#(?!#)\s+\S")), F.lit(1)), r"^#\s+", ""))
    slug = F.col("slug")
    found = F.array(
        rule("SCH01", none), rule("SCH02", ~none & (missing != ""), evidence=missing), rule("SCH03", ~empty("type") & ~F.col("type").isin(TYPES), evidence=F.col("type")),
        rule("SCH08", ~empty("name") & (T.normalize_slug(F.col("name")) != slug), evidence=F.col("name")), rule("SCH09", T.blank(F.col("body"))),
        rule("IDX09", slug.rlike("[A-Z]") | (F.contains(slug, F.lit("-")) & F.contains(slug, F.lit("_")))), rule("HYG01", F.exists(lines, lambda x: x.rlike(r"[ \t]+$")) | F.contains("body", F.lit("\r"))),
        rule("HYG04", ~empty("name") & (h1 == F.col("name"))), rule("HYG05", F.col("body").rlike(PLACEHOLDER), at(PLACEHOLDER)), rule("STA01", F.col("body").rlike(RELATIVE), at(RELATIVE)),
    )
    return n.select("vault", F.col("note").cast("string").alias("note"), F.explode(F.array_compact(found)).alias("f")).select("vault", "f.check", "note", "f.line", "f.evidence")


def link_rules(resolved: DataFrame, near: DataFrame) -> DataFrame:
    """Broken, ambiguous and self links; a wiki link to nothing is a finding only when exactly one slug is near."""
    few = near.groupBy("vault", "target").agg(F.count("*").alias("near"), F.min("slug").alias("guess"))
    lost = F.col("hits") == 0

    def rule(check: str, when: Column, evidence: str) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), F.col(evidence).alias("evidence")))

    found = F.array(rule("LNK03", F.col("to") == F.col("note"), "target"), rule("LNK04", F.col("hits") > 1, "target"), rule("LNK01", lost & (F.col("kind") == "wiki") & (F.col("near") == 1), "guess"), rule("LNK02", lost & (F.col("kind") == "markdown"), "target"))
    rows = resolved.join(few, ["vault", "target"], "left").select("vault", "note", F.col("line").cast("int").alias("line"), F.explode(F.array_compact(found)).alias("f"))
    return rows.select("vault", "f.check", F.col("note").cast("string").alias("note"), "line", "f.evidence")


def index_rules(entries: DataFrame, note_rows: DataFrame, state_rows: DataFrame) -> DataFrame:
    """Orphans, dangling entries, budget, malformed and repeated entries."""
    ok = state_rows.where("state = 'ok' and lines > 0").select("vault", "lines", "bytes", "over_budget")
    mine = entries.join(ok.select("vault"), "vault", "left_semi")
    target = F.lower("slug").alias("target")
    slugs = note_rows.where("slug is not null").select("vault", target).distinct()
    aimed = mine.where("target is not null")
    orphan = note_rows.join(ok.select("vault"), "vault", "left_semi").withColumn("target", F.lower("slug")).join(aimed.select("vault", "target").distinct(), ["vault", "target"], "left_anti")
    fold = mine.where("below_fold").groupBy("vault").agg(F.min("line").alias("line"), F.array_join(F.array_sort(F.collect_list("line")), ", ").alias("evidence"))
    twice = aimed.groupBy("vault", "target").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n > 1")
    parts = [
        _found(orphan, "IDX01"), _found(aimed.join(slugs, ["vault", "target"], "left_anti"), "IDX02", F.lit(INDEX), "line", "row"), _found(ok.where("over_budget"), "IDX04", F.lit(INDEX)),
        _found(fold, "IDX05", F.lit(INDEX), "line", "evidence"), _found(mine.where("kind = 'bare'"), "IDX07", F.lit(INDEX), "line", "row"), _found(twice, "IDX08", F.lit(INDEX), "line", "target"),
        _found(state_rows.where("state = 'monolithic'"), "IDX11", F.lit(INDEX)), _found(state_rows.where("state = 'empty'"), "IDX12", None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicates(note_rows: DataFrame) -> DataFrame:
    """(vault, body_hash, first, copies) of bodies that several notes share: one row a group, not one a pair."""
    full = note_rows.where(~T.blank(F.col("body")))
    return full.groupBy("vault", "body_hash").agg(F.min("note").alias("first"), F.count("*").alias("copies")).where("copies > 1")


def with_severity(findings: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return findings.withColumn("severity", table[F.col("check")])


def rank_of(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RANKS]), severity)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings as severe as that or more."""
    return findings.where(rank_of(F.col("severity")) <= RANKS.index(severity) + 1)


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, check, note and line."""
    return findings.orderBy(rank_of(F.col("severity")), "check", F.col("note").asc_nulls_first(), F.col("line").asc_nulls_first())


def triage(findings: DataFrame) -> DataFrame:
    """Per note: findings, the worst severity, and the first check of it. Findings of no note go to __vault__."""
    note = F.coalesce("note", F.lit("__vault__"))
    return findings.groupBy("vault", note.alias("note")).agg(F.count("*").alias("n"), F.min_by("severity", rank_of(F.col("severity"))).alias("worst"), F.min_by("check", F.struct(rank_of(F.col("severity")), F.col("check"))).alias("top_issue"))


def acceptable(findings: DataFrame) -> DataFrame:
    """Per vault: whether nothing of high or critical severity is left."""
    return findings.groupBy("vault").agg((~F.bool_or(F.col("severity").isin("high", "critical"))).alias("ok"))


def index_diff(entries: DataFrame, note_rows: DataFrame) -> DataFrame:
    """(vault, target, status): what is in the index only, in a file only, or in both."""
    files = note_rows.where("slug is not null").select("vault", F.lower("slug").alias("target")).distinct().withColumn("_file", F.lit(True))
    listed = entries.where("target is not null").select("vault", "target").distinct().withColumn("_listed", F.lit(True))
    status = F.when(F.col("_listed").isNull(), "file only").when(F.col("_file").isNull(), "index only").otherwise("both")
    return files.join(listed, ["vault", "target"], "full_outer").select("vault", "target", status.alias("status"))


def hook_drift(entries: DataFrame, note_rows: DataFrame) -> DataFrame:
    """(vault, note, line, hook, description) where an entry's hook and the note's description differ beyond case and outer blanks."""
    d = note_rows.where("description <> ''").select("vault", "note", F.lower("slug").alias("target"), "description")
    met = entries.where("hook is not null").join(d, ["vault", "target"])
    return met.where(F.lower(F.trim("hook")) != F.lower(F.trim("description"))).select("vault", "note", "line", "hook", "description")


def audit(files: DataFrame) -> DataFrame:
    """All findings of vaults read from files (vault, file, text). A vault that is empty or whose index is prose has that one finding."""
    index = files.where(F.col("file") == INDEX).select("vault", "text")
    md = files.where(F.lower("file").endswith(".md") & (F.col("file") != INDEX)).withColumn("slug", F.regexp_replace("file", r"(?i)\.md$", ""))
    n = notes(md, "vault", "slug", "slug", "text")
    found_links = links(n)
    resolved = resolve(found_links, n)
    lost = resolved.where("hits = 0 and target <> ''").select("vault", "target").distinct()
    near = near_matches(lost, n.select("vault", F.lower("slug").alias("slug")).distinct())
    entries = index_entries(index)
    state = states(index, entries, n)
    stray = _found(files.where(~F.lower("file").endswith(".md")), "IDX10", "file")
    secret = F.pandas_udf(_secret_lines, "int")
    secrets = _found(n.withColumn("line", secret("body")).where("line is not null"), "SEC01", line="line")
    same = duplicates(n)
    copies = _found(n.join(same, ["vault", "body_hash"]).where("note <> first"), "DUP01", evidence="first")
    alive = state.where("state = 'ok'").select("vault")
    inner = note_rules(n).unionByName(link_rules(resolved, near)).unionByName(stray).unionByName(secrets).unionByName(copies).join(alive, "vault", "left_semi")
    return inner.unionByName(index_rules(entries, n, state))


def _secret_lines(bodies: pd.Series) -> pd.Series:
    return pd.Series([first_secret_line(b) or 0 if b and redact(b) != b else None for b in bodies], dtype="Int64")
