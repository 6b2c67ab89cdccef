"""Tolerant front matter: a small YAML subset, nested under `metadata:` or flat."""

from __future__ import annotations

import re

import pandas as pd

FIELDS = {"name": "name", "description": "description", "type": "type", "node_type": "node_type", "originSessionId": "origin", "created": "created", "updated": "updated"}
SCHEMA = "shape string, name string, description string, type string, node_type string, origin string, created string, updated string, quoted boolean, extra map<string,string>, body string"


def parse(text: str | None) -> dict:
    """The fields, `shape` (nested, flat, none) and body of a note.

    Without a closed fence at the very top everything is body. A byte order mark and CRLF line ends are tolerated; the body of a note with front matter has
    plain line feeds. Null is an empty note.
    """
    text = (text or "").removeprefix("﻿")
    out = {k: None for k in FIELDS.values()} | {"shape": "none", "quoted": False, "extra": {}, "body": text}
    rows = re.split(r"\r?\n", text)
    if rows[0].strip() != "---":
        return out
    end = next((i for i, row in enumerate(rows[1:], 1) if row.strip() == "---"), None)
    if end is None:
        return out
    out |= {"shape": "flat", "body": "\n".join(rows[end + 1 :])}
    nested = False
    for row in rows[1:end]:
        if re.fullmatch(r"metadata\s*:\s*", row):
            out["shape"], nested = "nested", True
            continue
        nested = nested and (not row.strip() or row[0].isspace())
        key, colon, value = row.partition(":")
        key, value = key.strip(), value.strip()
        if not colon:
            continue
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        value = value[1:-1] if quoted else value
        allowed = set(FIELDS) - ({"name", "description"} if nested else set())
        if key in allowed:
            out[FIELDS[key]] = value
            out["quoted"] = quoted if key == "description" else out["quoted"]
        else:
            out["extra"][key] = value
    return out


def parse_all(texts: pd.Series) -> pd.DataFrame:
    """parse() over an Arrow batch, a column a field."""
    rows = [parse(t) for t in texts]
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return frame
