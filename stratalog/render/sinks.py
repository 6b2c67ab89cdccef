"""Writers of tables and reports."""

from __future__ import annotations

import html
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL, ROWS = 70, 25


def write_facts(tables: dict[str, DataFrame], out: str, order: dict[str, list[str]] | None = None) -> None:
    """Each table once as parquet, `out`/<table>.parquet, and from there as JSON lines without null fields, `out`/json/<table>; ordered where an order is given."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        rows = df.sparkSession.read.parquet(f"{out}/{name}.parquet")
        rows = rows.orderBy(*order[name]) if order and name in order else rows
        rows.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{out}/json/{name}")


def rows_of(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A report's rows as plain dicts; a table of more than `most` rows is no report and is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are not collected")
    return [r.asDict(recursive=True) for r in rows]


def report_json(sections: dict[str, DataFrame]) -> str:
    """All sections as one document, two spaces deep, nulls left out."""
    body = {name: [{k: v for k, v in r.items() if v is not None} for r in rows_of(df)] for name, df in sections.items()}
    return json.dumps({"schemaVersion": 1, **body}, indent=2, ensure_ascii=False, default=str)


def cell(value: object) -> str:
    """A value that fits a Markdown table: one line, pipes escaped, at most CELL characters."""
    text = "" if value is None else f"{value:g}" if isinstance(value, float) else str(value)
    text = " ".join(text.split()).replace("|", "\\|")
    return text if len(text) <= CELL else text[: CELL - 1] + "…"


def md_table(rows: list[dict], columns: list[str] | None = None, most: int = ROWS, total: int | None = None) -> str:
    """A Markdown table of the first rows that says how many it leaves out; `(none)` when there are none."""
    if not rows:
        return "(none)"
    columns = columns or list(rows[0])
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows[:most]]
    left = max(total or 0, len(rows)) - min(len(rows), most)
    return "\n".join(lines + [f"\n{left} more not shown"] * bool(left))


def report_md(title: str, sections: dict[str, DataFrame]) -> str:
    """Sections as headed tables. A section's `total` column, if it has one, is the number of rows there were."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = rows_of(df)
        total = rows[0].get("total") if rows else None
        out += [f"## {name.replace('_', ' ')}", md_table([{k: v for k, v in r.items() if k != "total"} for r in rows], total=total)]
    return "\n\n".join(out) + "\n"


def findings_json(findings: DataFrame) -> str:
    """Findings in a fixed key order, with counts by severity, zeros included; however many there are, fetched part by part."""
    rows = [r.asDict(recursive=True) for r in findings.toLocalIterator()]
    counts = {s: sum(r.get("severity") == s for r in rows) for s in ("critical", "high", "med", "low")}
    keys = ["vault", "check", "severity", "note", "line", "evidence"]
    return json.dumps({"schemaVersion": 1, "severityCounts": counts, "findings": [{k: r[k] for k in keys if r.get(k) is not None} for r in rows]}, indent=2, ensure_ascii=False)


def write_index(entries: DataFrame, folder: str, states: DataFrame | None = None, name: str = "MEMORY.md") -> list[str]:
    """Index files of reindexed vaults, one a vault; those whose index is prose are left alone. Returns the paths written."""
    blocked = {r.vault for r in states.where("state = 'monolithic'").select("vault").collect()} if states is not None else set()
    text = entries.groupBy("vault").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda e: e.entry), "\n").alias("text"))
    paths = []
    for r in rows_of(text):
        if r["vault"] not in blocked:
            path = Path(folder) / r["vault"] / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(r["text"] + "\n")
            paths.append(str(path))
    return sorted(paths)


def snapshot(folder: str, backups: str, label: str) -> str:
    """A copy of a vault's tree under backups/label; earlier backups inside it are left out."""
    target = Path(backups) / label
    skip = Path(backups).resolve()
    shutil.copytree(folder, target, ignore=lambda d, names: [n for n in names if (Path(d) / n).resolve() == skip])
    return str(target)


def undo(folder: str, backups: str) -> str:
    """Puts the latest snapshot back in a vault's place; files made since are removed."""
    last = max((p for p in Path(backups).iterdir() if p.is_dir()), key=lambda p: p.name)
    keep = Path(backups).resolve()
    for p in Path(folder).iterdir():
        if p.resolve() == keep or keep.is_relative_to(p.resolve()):
            continue
        shutil.rmtree(p) if p.is_dir() else p.unlink()
    shutil.copytree(last, folder, dirs_exist_ok=True)
    return str(last)


def page(title: str, parts: list[str], data: object = None) -> str:
    """A self-contained HTML page with its data embedded; `</` can't end the script early."""
    script = "" if data is None else f'<script type="application/json" id="data">{json.dumps(data, default=str).replace("</", "<\\/")}</script>'
    style = "body{font:14px system-ui;margin:2rem auto;max-width:70rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem;text-align:left}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}{script}</body></html>'


def html_table(rows: list[dict]) -> str:
    if not rows:
        return "<p>(none)</p>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v) if v is not None else '')}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
