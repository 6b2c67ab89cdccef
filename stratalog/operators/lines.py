"""Depth-first visitors over raw JSON lines, shared by the nesting, drift and reference operators.

A visitor is a plain Python function run by mapInArrow over record batches: one JSON parse a line, and
typed Arrow columns out. Lines that aren't a JSON object (blank, broken off, null) hold nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: One JSON token behind blanks; a string's inside is checked when it is decoded.
TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<sign>[\[\]{},:])|(?P<scalar>"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false|null|NaN|-?Infinity))', re.S)


def _deep(raw: str) -> object:
    """A JSON text of any depth: containers wait on a list of our own instead of the interpreter's stack. ValueError when it is none."""
    open_: list[tuple[object, str | None]] = []  # containers around the place, and the key under which the next one is put
    here, key, at = None, None, 0
    expect = "value"
    while True:
        m = TOKEN.match(raw, at)
        if m is None:
            raise ValueError("not JSON")
        at, sign = m.end(), m["sign"]
        if sign in ("]", "}"):
            if not (expect == "more" or expect == "first") or (sign == "]") != isinstance(here, list):
                raise ValueError("not JSON")
            value, (here, key) = here, open_.pop()
        elif sign == ",":
            if expect != "more":
                raise ValueError("not JSON")
            expect = "value" if isinstance(here, list) else "key"
            continue
        elif sign == ":":
            raise ValueError("not JSON")
        elif isinstance(here, dict) and expect in ("first", "key"):
            colon = TOKEN.match(raw, at)
            if sign or raw[m.start("scalar")] != '"' or colon is None or colon["sign"] != ":":
                raise ValueError("not JSON")
            key, at, expect = json.loads(m["scalar"]), colon.end(), "value"
            continue
        elif expect == "more":
            raise ValueError("not JSON")
        elif sign:
            open_.append((here, key))
            here, key, expect = [] if sign == "[" else {}, None, "first"
            continue
        else:
            value = json.loads(m["scalar"])
        if here is None:
            if raw[at:].strip(" \t\n\r"):
                raise ValueError("not JSON")
            return value
        if isinstance(here, list):
            here.append(value)
        else:
            here[key] = value
        expect = "more"


def parse(raw: str | None) -> dict | None:
    """The line's object, or None when it isn't one; nested to any depth."""
    if not raw:
        return None
    try:
        line = json.loads(raw)
    except RecursionError:
        try:
            line = _deep(raw)
        except ValueError:
            return None
    except ValueError:
        return None
    return line if isinstance(line, dict) else None


def dumps(value: object, indent: int | None = None, ascii_only: bool = True) -> str:
    """A value as JSON text, compact or indented; nested to any depth."""
    form = {"indent": indent, "ensure_ascii": ascii_only} | ({} if indent else {"separators": (",", ":")})
    try:
        return json.dumps(value, **form)
    except RecursionError:
        return _deep_dumps(value, form, indent)


def _deep_dumps(value: object, form: dict, indent: int | None) -> str:
    out: list[str] = []
    todo: list[object] = [("value", value, 0)]
    line = (lambda depth: "\n" + " " * (indent * depth)) if indent else lambda depth: ""
    while todo:
        what, x, depth = todo.pop()
        if what == "text" or not isinstance(x, (dict, list)) or not x:
            out.append(x if what == "text" else json.dumps(x, **form))
            continue
        keyed = isinstance(x, dict)
        parts = [(json.dumps(str(k), ensure_ascii=form["ensure_ascii"]) + (": " if indent else ":") if keyed else "", v) for k, v in (x.items() if keyed else enumerate(x))]
        out.append("{" if keyed else "[")
        todo.append(("text", line(depth) + ("}" if keyed else "]"), depth))
        for i in range(len(parts) - 1, -1, -1):
            todo.append(("value", parts[i][1], depth + 1))
            todo.append(("text", ("," if i else "") + line(depth + 1) + parts[i][0], depth + 1))
    return "".join(out)


def json_type(value: object) -> str:
    """JSON's name for the type of a parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (int, float)):
        return "number"
    return "object" if isinstance(value, dict) else "array"


def compact(value: object) -> str | None:
    """A value as text: strings as they are, anything else as compact JSON, null as null."""
    if value is None or isinstance(value, str):
        return value if value is None else value.encode("utf-8", "replace").decode()
    return dumps(value)


def number(value: object) -> float | None:
    """A finite number from a JSON number or numeric string, else None."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        x = float(value)
    except (ValueError, OverflowError):
        return None
    return x if math.isfinite(x) else None


def blocks(content: object) -> Iterator[tuple[str, str, str, object]]:
    """(path, parent_path, kind, block) of every content block, depth first; nesting is followed with a stack, to any depth."""
    if isinstance(content, str):
        yield "0", "", "text", content
        return
    if not isinstance(content, list):
        return
    stack: list[tuple[str, Iterator[tuple[int, object]]]] = [("", iter(enumerate(content)))]
    while stack:
        parent, rest = stack[-1]
        for i, block in rest:
            path = f"{parent}.{i}" if parent else str(i)
            if isinstance(block, str):
                yield path, parent, "text", block
            elif isinstance(block, dict):
                kind = block.get("type")
                yield path, parent, kind if isinstance(kind, str) else compact(kind) or "", block
                if isinstance(block.get("content"), list):
                    stack.append((path, iter(enumerate(block["content"]))))
                    break
            else:
                yield path, parent, "", block
        else:
            stack.pop()


def message(line: dict) -> dict:
    """The line's message object, or an empty one."""
    m = line.get("message")
    return m if isinstance(m, dict) else {}


def visit(df: DataFrame, columns: list[str], schema: str, each: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Run `each` over the rows of a batch (tuples of `columns`); it yields tuples in `schema`'s order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    typed = _parse_datatype_string(schema)
    arrow = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(each(zip(*[c.to_pylist() for c in batch.columns])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, typed)
