"""Deeply nested lines into flat related tables.

Method: single-pass tagged emission. A depth-first visitor parses each line once and emits
(table tag, primary key, parent key, payload); the tagged rows are written partitioned by tag, or one tag
is selected and its payload given that table's schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import lines as L

TAGGED = "tag string, line_id bigint, path string, parent_path string, kind string, payload string"
SCHEMAS = {
    "line": "type string, timestamp string, sessionId string, uuid string, requestId string, version string",
    "block": "type string, id string, name string, tool_use_id string, is_error boolean, text string, thinking string, content string, input string",
    "usage": "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint",
    "result": "stdout string, stderr string, interrupted boolean",
}


def _children(line: dict) -> Iterator[tuple[str, str, str, str, object]]:
    message = L.message(line)
    for path, parent, kind, block in L.blocks(message.get("content")):
        yield "block", path, parent, kind, block
    if isinstance(message.get("usage"), dict):
        yield "usage", "usage", "", "usage", message["usage"]
    if isinstance(line.get("toolUseResult"), dict):
        yield "result", "toolUseResult", "", "toolUseResult", line["toolUseResult"]


def _payload(value: object) -> str:
    """The value's own fields, inner objects and arrays as text, so that a payload is flat however deep the value is."""
    own = value if isinstance(value, dict) else {"text": value}
    return L.compact({k: L.compact(v) if isinstance(v, (dict, list)) else v for k, v in own.items()})


def _emit(payloads: bool) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """The one visitor; without payloads it emits the skeleton."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for line_id, raw in rows:
            line = L.parse(raw)
            if line is None:
                continue
            own = {k: v for k, v in line.items() if k not in ("message", "toolUseResult")}
            yield "line", line_id, "", None, line.get("type") if isinstance(line.get("type"), str) else None, _payload(own) if payloads else None
            for tag, path, parent, kind, value in _children(line):
                yield tag, line_id, path, parent, kind, _payload(value) if payloads else None

    return each


def flatten(transcript_lines: DataFrame, payloads: bool = True) -> DataFrame:
    """Every table's rows in one tagged DataFrame (schema TAGGED), each (tag, line_id, path) once.

    Repeated deliveries give the same keys and are dropped after the emission; with payloads these are shuffled for it, without
    them keys alone. Lines that aren't JSON objects give nothing; a line with null line_id keeps a null key.
    """
    return L.visit(transcript_lines, ["line_id", "raw"], TAGGED, _emit(payloads)).dropDuplicates(["tag", "line_id", "path"])


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """One flat table: keys plus the payload under the schema of that tag; a value of another type becomes null, not an error."""
    data = tagged.where(F.col("tag") == tag).withColumn("data", F.from_json("payload", SCHEMAS[tag]))
    return data.select("line_id", "path", "parent_path", "kind", "data.*")


def write_flat(tagged: DataFrame, path: str) -> None:
    """All tables, written once, partitioned by tag."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def children(transcript_lines: DataFrame) -> DataFrame:
    """The parent-child skeleton alone: line_id, path, parent_path, kind of every block, usage and result."""
    return flatten(transcript_lines, payloads=False).where("tag <> 'line'").select("line_id", "path", "parent_path", "kind")
