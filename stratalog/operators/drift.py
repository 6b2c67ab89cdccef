"""One consistent table out of lines whose schema drifts, and a report of each change per file.

Method: tagged-union inference. Every line is read once; its paths are fused with the parallel schema of
the same line type, each path keeping all JSON types seen for it (`alternatives` by file, `union` over all).
What the contract doesn't have, or has with another type, goes to a typed branch of the landed row, and is
also converted to the contract's type where it has one; alternatives that appear are the report.

A rename is a required field gone from an object in which a new field carries its values. Which new field
that is, is decided over the whole corpus, not line by line: the pair must have a common JSON type, the new
field must stand where the old one is missing, and either the names or the shapes of the values must agree.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stratalog.operators import lines as L
from stratalog.sources.tables import checkpointed

#: Share of a new field's lines on which the missing one is missing, and least likeness of names or values.
EXCLUSIVE, ALIKE = 0.5, 0.5
OPAQUE = "message.content"
MAX_CONTRACT = 100_000
FACTS = "tag string, sid string, line_type string, path string, other string, value string, n bigint"


class Contract:
    """The agreed schema, as a tree by line type. It is collected, so its size is checked."""

    def __init__(self, df: DataFrame):
        rows = df.select("line_type", "path", "json_types", "required").limit(MAX_CONTRACT + 1).collect()
        if len(rows) > MAX_CONTRACT:
            raise ValueError(f"a line contract of more than {MAX_CONTRACT} rows is no contract")
        self.types: dict[str, dict[str, frozenset[str]]] = defaultdict(dict)
        self.required: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for line_type, path, json_types, required in rows:
            if line_type is None or path is None:
                continue
            self.types[line_type][path] = frozenset((json_types or "").split("|"))
            if required:
                self.required[line_type][path.rpartition(".")[0]].append(path)
        self.types, self.required = dict(self.types), {k: dict(v) for k, v in self.required.items()}

    def line_type(self, line: dict) -> str | None:
        """The contract's type that the line states: in `type`, inside it, or in another field of its own."""
        stated = line.get("type")
        if isinstance(stated, str) and stated in self.types:
            return stated
        inner = list(stated.values()) if isinstance(stated, dict) else stated if isinstance(stated, list) else []
        outer = sorted(((k, v) for k, v in line.items() if k != "type"), key=lambda kv: ("type" not in kv[0].lower(), kv[0]))
        deeper = [v for _, o in outer if isinstance(o, dict) for k, v in o.items() if "type" in k.lower()]
        for v in [*inner, *(v for _, v in outer), *deeper]:
            if isinstance(v, str) and v in self.types:
                return v
        return None


def shape(value: object) -> str:
    """What a value looks like: single words as they are, else runs of letters, digits and blanks as one sign each; numbers by their magnitude.

    The whole value counts; a long mask is replaced by a digest of itself.
    """
    if isinstance(value, str):
        if re.fullmatch(r"[A-Za-z_-]+", value):
            return _short("=" + value)
        return _short(re.sub(r"\s+", " ", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9a-f]{8,}", "h", value)))))
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return f"n{len(str(abs(int(value)))) // 2}" if abs(value) < 1e18 else "n"
    return _short(L.json_type(value) + ",".join(sorted(value))) if isinstance(value, dict) else "array"


def _short(mask: str) -> str:
    return mask if len(mask) <= 32 else "#" + hashlib.blake2b(mask.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _words(path: str) -> set[str]:
    name = path.rpartition(".")[2]
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)}


def name_likeness(old: str, new: str) -> float:
    """Shared words of two field names over those of the shorter one, whatever case or separator they are written in."""
    a, b = _words(old), _words(new)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


@F.pandas_udf(DoubleType())
def likeness(old: pd.Series, new: pd.Series) -> pd.Series:
    """name_likeness() over Arrow batches."""
    return pd.Series([name_likeness(a, b) for a, b in zip(old, new)], dtype=float)


def place(parent: str, key: str) -> str:
    """Dotted path of a key; a dot inside a key is marked, so that it can't pass for nesting."""
    key = key.replace(".", "\\.") if "." in key else key
    return f"{parent}.{key}" if parent else key


def fuse(line: dict, line_type: str, contract: Contract, note: Callable[..., None]) -> None:
    """Notes a line's differences from the contract: note(tag, path, other, value).

    Tags: added, retyped, removed; `open` when an object lacks required fields and has new ones, so
    that only the corpus can tell; `new`, `gone` and `old` feed that decision.
    """
    types, required = contract.types[line_type], contract.required.get(line_type, {})
    todo = [("", line)]
    while todo:
        parent, obj = todo.pop()
        prefix = parent + "." if parent else ""
        new = {}
        for key, value in obj.items():
            path = place(parent, key)
            allowed = types.get(path)
            if value is None:
                continue
            if allowed is None:
                new[path] = value
            elif L.json_type(value) not in allowed:
                note("retyped", path, "", "")
            elif isinstance(value, dict):
                if path != OPAQUE:
                    todo.append((path, value))
            elif path in required.get(parent, ()):
                note("old", path, "", shape(value))
        gone = [p for p in required.get(parent, ()) if p[len(prefix):] not in obj]
        for path, value in new.items():
            note("new", path, L.json_type(value), shape(value))
            for old in gone:
                if L.json_type(value) in types[old]:
                    note("gone", path, old, "")
        if new and gone:
            note("open", "\n".join(sorted(gone)), "\n".join(sorted(new)), "")
        else:
            for path in gone:
                note("removed", path, "", "")
            for path in new:
                note("added", path, "", "")


def _facts(contract: Contract) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    per_file = {"added", "removed", "retyped", "open"}

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for sid, raw in rows:
            line = L.parse(raw)
            line_type = contract.line_type(line) if line else None
            if line_type:
                def note(tag: str, path: str, other: str, value: str) -> None:
                    counts[tag, sid if tag in per_file else None, line_type, path, other, value] += 1

                fuse(line, line_type, contract, note)
        for key, n in counts.items():
            yield *key, n

    return each


def facts(transcript_lines: DataFrame, contract: Contract) -> DataFrame:
    """The fused schema differences of all lines, pre-aggregated by batch and then once more by key."""
    found = L.visit(transcript_lines, ["sid", "raw"], FACTS, _facts(contract))
    return found.groupBy("tag", "sid", "line_type", "path", "other", "value").agg(F.sum("n").alias("n"))


def renames(found: DataFrame) -> DataFrame:
    """Pairs (line_type, old, new, score) of a contract field and the new field that carries its values."""
    profile = found.where("tag in ('new', 'old')").groupBy("line_type", "tag", "path", "value").agg(F.sum("n").alias("n"))
    totals = profile.groupBy("line_type", "tag", "path").agg(F.sum("n").alias("total"))
    shares = profile.join(totals, ["line_type", "tag", "path"]).withColumn("share", F.col("n") / F.col("total"))
    a = shares.where("tag = 'new'").select("line_type", F.col("path").alias("new"), "value", F.col("share").alias("a"))
    b = shares.where("tag = 'old'").select("line_type", F.col("path").alias("old"), "value", F.col("share").alias("b"))
    pairs = found.where("tag = 'gone'").groupBy("line_type", F.col("path").alias("new"), F.col("other").alias("old")).agg(F.sum("n").alias("together"))
    pairs = pairs.join(totals.where("tag = 'new'").select("line_type", F.col("path").alias("new"), "total"), ["line_type", "new"])
    pairs = pairs.where(F.col("together") >= EXCLUSIVE * F.col("total"))
    alike = pairs.join(a, ["line_type", "new"]).join(b, ["line_type", "old", "value"]).groupBy("line_type", "old", "new").agg(F.sum(F.least("a", "b")).alias("values"))
    scored = pairs.join(alike, ["line_type", "old", "new"], "left").withColumn("names", likeness("old", "new"))
    scored = scored.fillna(0.0, ["values"]).where((F.col("names") >= ALIKE) | (F.col("values") >= ALIKE))
    return scored.select("line_type", "old", "new", (F.col("names") + F.col("values") + F.col("together") / F.col("total")).alias("score"))


def changes(transcript_lines: DataFrame, line_contract: DataFrame) -> DataFrame:
    """Each change per file: sid, line_type, path, change; distinct.

    Blank, broken and null lines hold nothing; lines that state no type of the contract aren't judged; JSON
    null is no change; a null sid is a file of its own. An empty table or contract gives no rows.
    """
    found = checkpointed(facts(transcript_lines, Contract(line_contract)))
    plain = found.where("tag in ('added', 'removed', 'retyped')").select("sid", "line_type", "path", F.col("tag").alias("change"))
    open_ = found.where("tag = 'open'").select("sid", "line_type", F.split("path", "\n").alias("gone"), F.split("other", "\n").alias("fresh")).distinct()
    known = checkpointed(renames(found))
    # An object has few missing fields and few new ones; their pairs are looked up, best first, each new field used once.
    options = open_.withColumn("old", F.explode("gone")).withColumn("new", F.explode("fresh")).join(known, ["line_type", "old", "new"], "left")
    options = options.groupBy("sid", "line_type", "gone", "fresh").agg(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("score", "old", "new"))), asc=False).alias("options"))
    taken = F.aggregate(
        "options",
        F.array().cast("array<struct<score:double,old:string,new:string>>"),
        lambda got, o: F.when(F.exists(got, lambda g: (g.old == o.old) | (g.new == o.new)), got).otherwise(F.concat(got, F.array(o))),
    )
    settled = options.withColumn("taken", taken).withColumns({"olds": F.col("taken.old"), "news": F.col("taken.new")})
    parts = [("renamed", F.col("olds")), ("removed", F.array_except("gone", "olds")), ("added", F.array_except("fresh", "news"))]
    report = plain
    for change, paths in parts:
        report = report.unionByName(settled.select("sid", "line_type", F.explode(paths).alias("path"), F.lit(change).alias("change")))
    return report.distinct()


def delivered(line: dict, types: dict[str, frozenset[str]]) -> Iterator[tuple[dict, str, str, object, bool]]:
    """(object around it, path, JSON type, value, whether the contract has it so) of everything in a line that isn't opened further.

    Opened are objects that the contract has as such, except for message.content. JSON null fits any type. `types` is empty for
    a line whose type the contract doesn't have, so each of its fields is new.
    """
    todo = [("", line)]
    while todo:
        parent, obj = todo.pop()
        for key, value in obj.items():
            path, kind = place(parent, key), L.json_type(value)
            allowed = types.get(path)
            agreed = allowed is not None and (value is None or kind in allowed)
            if agreed and value and isinstance(value, dict) and path != OPAQUE:
                todo.append((path, value))
            else:
                yield obj, path, kind, value, agreed


def _shapes(contract: Contract) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        told: set[str] = set()
        for line_id, sid, raw in rows:
            line = L.parse(raw)
            if line is None:
                continue
            line_type = contract.line_type(line)
            found = sorted((path, kind, agreed) for _, path, kind, _, agreed in delivered(line, contract.types.get(line_type, {})))
            text = L.dumps({"line_type": line_type, "found": [{"path": p, "json_type": k, "agreed": a} for p, k, a in found]})
            digest = hashlib.blake2b(text.encode(), digest_size=16).hexdigest()
            yield line_id, sid, digest, None if digest in told else text
            told.add(digest)

    return each


def alternatives(transcript_lines: DataFrame, line_contract: DataFrame) -> DataFrame:
    """The tagged union of each file: (sid, line_type, path, json_type, agreed, n), n being lines that have that type at that path.

    agreed: the contract has it so. line_type is null for lines that state no type of the contract; their fields are never agreed.
    Each line_id counts once, each line without one by itself. Lines are told apart by their shape, of which there are few: an
    id and a digest a line are shuffled, and a shape is opened once a file.
    """
    shapes = L.visit(transcript_lines, ["line_id", "sid", "raw"], "line_id bigint, sid string, digest string, text string", _shapes(Contract(line_contract)))
    shapes = checkpointed(shapes)
    once = shapes.where("line_id is not null").groupBy("line_id").agg(F.min(F.struct("sid", "digest")).alias("l")).select("l.*")
    once = once.unionByName(shapes.where("line_id is null").select("sid", "digest"))
    texts = shapes.where("text is not null").groupBy("digest").agg(F.first("text").alias("text"))
    opened = F.from_json("text", "line_type string, found array<struct<path:string,json_type:string,agreed:boolean>>")
    by_file = once.groupBy("sid", "digest").agg(F.count("*").alias("n")).join(texts, "digest").select("sid", "n", opened.alias("o"))
    rows = by_file.select("sid", "n", "o.line_type", F.explode("o.found").alias("f")).select("sid", "line_type", "f.*", "n")
    return rows.groupBy("sid", "line_type", "path", "json_type", "agreed").agg(F.sum("n").alias("n"))


def union(found: DataFrame) -> DataFrame:
    """Alternatives of all files fused: (line_type, path, json_type, agreed, n_lines, n_files)."""
    return found.groupBy("line_type", "path", "json_type", "agreed").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_files"))


def _landed(contract: Contract, renamed: dict[tuple[str, str], list[tuple[float, str]]]) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for line_id, sid, line_no, raw in rows:
            line = L.parse(raw)
            if line is None:
                continue
            line_type = contract.line_type(line)
            types, fields, branches, options = contract.types.get(line_type, {}), {}, {}, []
            for obj, path, kind, value, agreed in delivered(line, types):
                if agreed:
                    fields[path] = {"value": L.compact(value), "how": "as delivered", "json_type": kind}
                    continue
                branches[path] = {"json_type": kind, "value": L.compact(value)}
                if path in types:
                    fields[path] = {"value": canonical(value, types[path]), "how": "converted", "json_type": kind}
                for score, old in renamed.get((line_type, path), ()):
                    if old.rpartition(".")[2] not in obj:
                        options.append((score, old, path, kind, value))
            used = set()
            for _, old, path, kind, value in sorted(options, key=lambda o: o[:3], reverse=True):
                if old not in fields and path not in used:
                    used.add(path)
                    fields[old] = {"value": canonical(value, types[old]), "how": "renamed", "json_type": kind}
            if line_type and fields.get("type", {}).get("value") != line_type:
                fields["type"] = {"value": line_type, "how": "converted", "json_type": "string"}
            yield line_id, sid, line_no, line_type, list(fields.items()), list(branches.items())

    return each


def canonical(value: object, allowed: frozenset[str]) -> str | None:
    """A value of another type in the contract's type, as text; null when nothing of that type is in it."""
    if isinstance(value, dict):
        inner = [v for v in value.values() if L.json_type(v) in allowed]
        return L.compact(inner[0]) if inner else None
    if "boolean" in allowed and str(value).lower() in ("true", "false", "1", "0"):
        return "true" if str(value).lower() in ("true", "1") else "false"
    if "number" in allowed:
        x = L.number(value)
        return None if x is None else L.compact(int(x) if x == int(x) else x)
    if "string" in allowed:
        return ".".join(map(str, value)) if isinstance(value, list) else L.compact(value)
    return None


LANDED = "line_id bigint, sid string, line_no int, line_type string, fields map<string,struct<value:string,how:string,json_type:string>>, branches map<string,struct<json_type:string,value:string>>"


def land(transcript_lines: DataFrame, line_contract: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """All lines in one table: keys, line_type, `fields` (contract path -> value in the contract's type, and how it got there:
    as delivered, converted or renamed) and `branches` (path as delivered -> JSON type and value, for whatever the
    contract doesn't have or has with another type). Nothing is lost: each path of a line is in one of them.

    A renamed field's value goes to the contract's field where that one is absent, never over it. Lines of a type outside the
    contract land with a null line_type and branches alone. A repeated line_id lands once, deliveries being alike; a line
    without an id lands by itself. Lines that aren't JSON objects hold nothing.
    renamed: pairs as of renames(); collected, since a contract has few fields and each pair names one (checked).
    """
    contract = Contract(line_contract)
    pairs: dict[tuple[str, str], list[tuple[float, str]]] = defaultdict(list)
    if renamed is not None:
        rows = renamed.limit(MAX_CONTRACT + 1).collect()
        if len(rows) > MAX_CONTRACT:
            raise ValueError("more renames than a contract can have fields")
        for r in rows:
            pairs[r.line_type, r.new].append((r.score, r.old))
    slim = transcript_lines.select("line_id", "sid", "line_no", "raw")
    once = slim.where("line_id is not null").dropDuplicates(["line_id"]).unionByName(slim.where("line_id is null"))
    return L.visit(once, ["line_id", "sid", "line_no", "raw"], LANDED, _landed(contract, dict(pairs)))


def as_delivered(landed: DataFrame) -> DataFrame:
    """Landed lines as rows (line_id, line_type, path, json_type, agreed, value): each path of each line once, as it came."""
    fields = landed.select("line_id", "line_type", F.explode("fields").alias("path", "f")).where("f.how = 'as delivered'")
    branches = landed.select("line_id", "line_type", F.explode("branches").alias("path", "f"))
    rows = [d.select("line_id", "line_type", "path", "f.json_type", F.lit(agreed).alias("agreed"), "f.value") for d, agreed in ((fields, True), (branches, False))]
    return rows[0].unionByName(rows[1])


def wide(landed: DataFrame, line_contract: DataFrame) -> DataFrame:
    """One column a contract path (dots as double underscores) in the contract's type, `_rest` for what it has no place for."""
    contract = Contract(line_contract)
    kinds: dict[str, set[str]] = defaultdict(set)
    for types in contract.types.values():
        for path, allowed in types.items():
            kinds[path] |= allowed
    def typed(path: str) -> str:
        return "double" if kinds[path] == {"number"} else "boolean" if kinds[path] == {"boolean"} else "string"

    columns = [F.col("fields")[p]["value"].try_cast(typed(p)).alias(p.replace(".", "__")) for p in sorted(kinds) if kinds[p] != {"object"}]
    return landed.select("line_id", "sid", "line_no", "line_type", *columns, F.to_json("branches").alias("_rest"))
