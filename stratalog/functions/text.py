"""Text functions as Column expressions, evaluated in the JVM.

Lengths are in UTF-16 code units where they feed token estimates or clips, since the logs count them so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of blocks that a harness puts into a user turn.
HARNESS_TAGS = ["system-reminder", "task-notification", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr"]
#: How machine-made turns begin.
HARNESS_OPENERS = [
    r"\[Request interrupted", "<system-reminder", "<task-notification", "<command-name", "<command-message", "<command-args", "<local-command",
    "Caveat: The messages below", "API Error", r"\[Tool result",
]
#: Words too common to tell requests apart.
STOPWORDS = (
    "the and for you that this with have from are not but can should would could please just now then was were what when where which how why all any "
    "its it's our your their them they there here get got let make made use using used need want one two into out off over some same than also about after "
    "before again still very more most will does did done doing has had been being like only"
).split()
#: Masks of an error signature, in order.
SIGNATURE_MASKS = [
    (r"(?i)[a-z][a-z0-9+.-]*://\S+", "<url>"),
    (r"'[^']*'|\"[^\"]*\"|`[^`]*`", "<str>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?:[A-Za-z]:)?(?:[\w.@~+-]*[\\/])+[\w.@+-]*", "<path>"),
    (r"(?i)\b[0-9a-f]{7,}\b", "<hash>"),
    (r"\b\d+(?:[.,]\d+)*\b", "<n>"),
]
#: Extensions and their media types.
MEDIA_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "avif": "image/avif",
    "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "mp3": "audio/mpeg", "wav": "audio/wav", "pdf": "application/pdf",
    "json": "application/json", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "css": "text/css", "js": "text/javascript", "zip": "application/zip",
}


def length16(s: Column) -> Column:
    """UTF-16 code units, so an emoji counts two; 0 for null."""
    return F.coalesce((F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("bigint"), F.lit(0).cast("bigint"))


def clip(s: Column, n: int, mark: str = "") -> Column:
    """The first n characters, with a mark when something was cut."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(mark))).otherwise(s)


def cap(s: Column, n: int) -> Column:
    """The first n characters and how many more there were."""
    more = F.concat(F.substring(s, 1, n), F.lit("\n… ["), (F.length(s) - n).cast("string"), F.lit(" more chars]"))
    return F.when(F.length(s) > n, more).otherwise(s)


def collapse(s: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def blank(s: Column) -> Column:
    """Whether nothing but white space of any script is there."""
    return s.rlike(r"(?U)\A[\s\x{FEFF}]*\z")


def first_line(s: Column, n: int = 200) -> Column:
    """The first line that isn't blank, trimmed, at most n characters; empty when there is none."""
    lines = F.filter(F.split(s, r"\n"), lambda x: F.trim(x) != "")
    return F.substring(F.coalesce(F.trim(F.try_element_at(lines, F.lit(1))), F.lit("")), 1, n)


def est_tokens(s: Column) -> Column:
    """A quarter of the length, rounded half up."""
    return F.floor(length16(s) / 4 + 0.5).cast("bigint")


def strip_harness(s: Column) -> Column:
    """The text without blocks put in by a harness."""
    for tag in HARNESS_TAGS:
        s = F.regexp_replace(s, f"<{tag}>[\\s\\S]*?</{tag}>", "")
    return F.trim(s)


def machine_made(s: Column) -> Column:
    return s.rlike("^(?:" + "|".join(HARNESS_OPENERS) + ")")


def matchable(s: Column) -> Column:
    """Lower case, without fenced code, quoted lines and tagged blocks."""
    s = F.regexp_replace(s, r"```[\s\S]*?(?:```|$)", " ")
    s = F.regexp_replace(s, r"(?m)^\s*>.*$", " ")
    return F.lower(F.regexp_replace(s, r"(?i)<[a-z-]+>[\s\S]*?</[a-z-]+>", " "))


def request_key(s: Column) -> Column:
    """The first ten of a request's significant words, distinct and sorted; empty for fewer than four."""
    plain = F.regexp_replace(matchable(s), r"[^a-z0-9\s./_-]+", " ")
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = F.array_sort(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))))
    return F.when(F.size(words) < 4, F.lit("")).otherwise(F.array_join(F.slice(words, 1, 10), " "))


def error_signature(s: Column) -> Column:
    """The first two lines with their particulars masked, at most 200 characters."""
    lines = F.filter(F.split(s, r"\n"), lambda x: F.trim(x) != "")
    out = F.array_join(F.slice(lines, 1, 2), " ")
    for pattern, mask in SIGNATURE_MASKS:
        out = F.regexp_replace(out, pattern, mask)
    return F.substring(collapse(out), 1, 200)


def first_capture(s: Column, patterns: list[str], skip: list[str]) -> Column:
    """Group 1 of the first pattern that matches with something not in `skip`; null when none does."""
    tries = []
    for p in patterns:
        hit = F.trim(F.regexp_extract(s, p, 1))
        tries.append(F.when((hit != "") & ~hit.isin(skip), hit))
    return F.coalesce(*tries)


def normalize_slug(s: Column) -> Column:
    """The note a link target names: no fragment, alias, folder or extension; lower case."""
    s = F.regexp_replace(F.trim(s), r"[#|].*$", "")
    s = F.element_at(F.split(F.trim(s), "/"), -1)
    return F.lower(F.trim(F.regexp_replace(s, r"(?i)\.md$", "")))


def words(s: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(s: Column, k: int) -> Column:
    """A 64-bit hash of each k successive words; the words are an array that is evaluated once."""
    none = F.array().cast("array<bigint>")
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))
    return F.element_at(F.transform(F.array(words(s)), lambda w: F.when(F.size(w) >= k, each(w)).otherwise(none)), 1)


def shingles(s: Column, k: int = 3) -> Column:
    """Distinct runs of k words, one pass over an array that is evaluated once."""
    made = F.transform(
        F.array(words(s)), lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.element_at(made, 1))


def terms(s: Column, least: int = 5) -> Column:
    """Distinct words of at least so many letters."""
    return F.array_distinct(F.filter(words(s), lambda w: F.length(w) >= least))


def body_hash(s: Column) -> Column:
    return F.sha1(F.lower(collapse(s)).cast("binary"))


def encode_slug(path: Column) -> Column:
    return F.translate(path, "/.", "--")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, 99 where the lengths alone are more than 3 apart."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 3, 99).otherwise(F.levenshtein(a, b))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common beginning of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(same))


def wiki_and_markdown_links(line: Column) -> tuple[Column, Column]:
    """Raw targets of [[wiki]] links and of [text](target) links that lead to a file."""
    wiki = F.regexp_extract_all(line, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))
    mark = F.regexp_extract_all(line, F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    return wiki, F.filter(mark, lambda t: ~t.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"))


def group_of(check: Column) -> Column:
    return F.regexp_replace(check, r"\d+$", "")


def mime_of(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.when(ext != "", F.try_element_at(table, ext)), F.lit("application/octet-stream"))


def or_none(s: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(s), F.lit("")), F.lit("none"))


def clip_error(s: Column, n: int = 240) -> Column:
    """An error in one short line without credentials."""
    s = F.regexp_replace(collapse(s), r"(?i)(bearer\s+)[\w.~+/-]+=*", "$1[redacted]")
    s = F.regexp_replace(s, r"(?i)((?:token|secret|password|api[_-]?key)[\"']?\s*[:=]\s*[\"']?)[^\s\"',}]+", "$1[redacted]")
    s = F.regexp_replace(s, r"://[^/\s:@]+:[^/\s@]+@", "://[redacted]@")
    return F.substring(s, 1, n)


def escape_html(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def primary_arg(tool: Column, input_json: Column) -> Column:
    """The argument that says what a call touched; null for tools without one."""
    def pick(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(input_json, f"$.{k}"), F.lit("")) for k in keys])

    return (
        F.when(tool.isin("Read", "Edit", "Write", "MultiEdit", "NotebookEdit"), pick("file_path", "notebook_path", "path"))
        .when(tool.isin("Grep", "Glob"), pick("pattern"))
        .when(tool == "WebFetch", pick("url"))
        .when(tool == "WebSearch", pick("query"))
        .when(tool.isin("Agent", "Task"), pick("subagent_type", "description"))
        .when(tool == "Skill", pick("skill", "command"))
    )
