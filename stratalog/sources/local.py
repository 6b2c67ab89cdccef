"""What is read on the driver: small files beside the data, and remote lists."""

from __future__ import annotations

import json
import os
import re
import subprocess
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from stratalog.functions.text import MEDIA_TYPES

LOCKFILES = {"bun.lock": "bun", "bun.lockb": "bun", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package-lock.json": "npm"}
RULE_FILES = ["CLAUDE.md", "AGENTS.md", ".claude/CLAUDE.md"]


def session_path(root: str, wanted: str) -> str:
    """The transcript of a session id (or a path to it) in the first project that has it; an error when none has."""
    if Path(wanted).is_file():
        return wanted
    found = sorted(Path(root).glob(f"*/{wanted}.jsonl")) or sorted(Path(root).rglob(f"{wanted}.jsonl"))
    if not found:
        raise LookupError(f"no transcript of {wanted} below {root}")
    return str(found[0])


def subagents(spark: SparkSession, transcript: str) -> DataFrame:
    """(id, path, agent_type, description, tool_use_id) of a session's child transcripts, with their side files."""
    folder, rows = Path(transcript).with_suffix("") / "subagents", []
    for path in sorted(folder.rglob("agent-*.jsonl")):
        side = path.with_suffix(".meta.json")
        try:
            meta = json.loads(side.read_text()) if side.exists() else {}
        except ValueError:
            meta = {}
        rows.append((path.stem.removeprefix("agent-"), str(path), meta.get("agentType"), meta.get("description"), meta.get("toolUseId")))
    return spark.createDataFrame(rows, "id string, path string, agent_type string, description string, tool_use_id string")


def rollout_path(root: str, wanted: str) -> str:
    """A log in the second format whose file name holds the id."""
    found = sorted(p for p in Path(root).rglob("*.jsonl") if wanted in p.name)
    if not found:
        raise LookupError(f"no log of {wanted} below {root}")
    return str(found[-1])


def is_rollout(path: str) -> bool:
    """Whether a file's first record is of the second format."""
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            if line.strip():
                try:
                    return json.loads(line).get("type") in ("session_meta", "response_item", "turn_context", "event_msg")
                except (ValueError, AttributeError):
                    return False
    return False


def context_files(spark: SparkSession, home: str, cwd: str, memory: str | None = None) -> DataFrame:
    """(label, path, bytes, tokens, scope) of rule files that load with a session; a memory folder counts as one."""
    rows = []
    for scope, base, names in (("global", Path(home) / ".claude", ["CLAUDE.md"]), ("project", Path(cwd), RULE_FILES)):
        for name in names:
            if (p := base / name).is_file():
                rows.append((name, str(p), p.stat().st_size, p.stat().st_size // 4, scope))
    if memory and Path(memory).is_dir():
        size = sum(p.stat().st_size for p in Path(memory).glob("*.md"))
        rows.append(("memory", memory, size, size // 4, "memory"))
    return spark.createDataFrame(rows, "label string, path string, bytes bigint, tokens bigint, scope string")


def vaults(spark: SparkSession, root: str) -> DataFrame:
    """(slug, files) of projects with notes, most files first."""
    rows = [(p.name, n) for p in Path(root).iterdir() if p.is_dir() and (n := sum(1 for _ in (p / "memory").glob("*.md")))] if Path(root).is_dir() else []
    return spark.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "slug string, files int")


def resolve_project(root: str, wanted: str | None = None, cwd: str | None = None) -> str:
    """A project folder below `root`: by path, by slug, by its end, by any part of it, or by the repository around `cwd`."""
    slug = lambda p: re.sub(r"[/.]", "-", str(p))
    names = sorted(p.name for p in Path(root).iterdir() if p.is_dir())
    if wanted:
        if Path(wanted).is_dir() and slug(Path(wanted).resolve()) in names:
            return slug(Path(wanted).resolve())
        for fits in (lambda n: n == wanted, lambda n: n.endswith(wanted), lambda n: wanted in n):
            hits = [n for n in names if fits(n)]
            if len(hits) == 1:
                return hits[0]
        raise LookupError(f"{wanted}: no single project")
    top = subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=cwd, capture_output=True, text=True).stdout.strip()
    if slug(top or cwd or os.getcwd()) in names:
        return slug(top or cwd or os.getcwd())
    raise LookupError("this folder is no known project")


def project_probe(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(cwd, exists, rules, package_manager, scripts) of working folders."""
    rows = []
    for folder in folders:
        base, declared, scripts = Path(folder), None, []
        try:
            package = json.loads((base / "package.json").read_text())
            declared = str(package.get("packageManager", "")).split("@")[0] or None
            scripts = sorted(package.get("scripts", {}))
        except (OSError, ValueError, AttributeError):
            pass
        manager = declared or next((m for f, m in LOCKFILES.items() if (base / f).is_file()), None)
        rows.append((folder, base.is_dir(), any((base / f).is_file() for f in RULE_FILES), manager, scripts))
    return spark.createDataFrame(rows, "cwd string, exists boolean, rules boolean, package_manager string, scripts array<string>")


def env_file(path: str) -> dict[str, str]:
    """KEY=value lines, `export` allowed, quotes taken off, comments and anything else ignored."""
    out = {}
    for line in Path(path).read_text().splitlines():
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
        if m and not line.lstrip().startswith("#"):
            v = m[2]
            out[m[1]] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else re.sub(r"\s+#.*$", "", v)
    return out


def http_list(spark: SparkSession, url: str, token: str, schema: str, field: str | None = None, timeout: float = 30) -> DataFrame:
    """Rows of an authenticated JSON list."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"}), timeout=timeout) as r:
        body = json.load(r)
    rows = body[field] if field else body
    return spark.read.schema(schema).json(spark.createDataFrame([(json.dumps(x),) for x in rows], "value string")) if rows else spark.createDataFrame([], schema)


def media_type(name: str) -> str:
    return MEDIA_TYPES.get(name.rpartition(".")[2].lower(), "application/octet-stream")
