"""Personal information in free text, found and replaced by typed placeholders.

Method: information-theoretic sanitisation. Protected entities are e-mail addresses, phone numbers, state-issued
numbers and street addresses; most of them stand in a corpus once, so co-occurrence says nothing of them and their
form decides. Names have no form. Over the whole corpus it is counted how often each term occurs at all and how
often as part of a protected entity (in the local part of an e-mail address, or in a name-shaped phrase bound to an
entity or to an author's field). The share p(protected | term), which is two to the power of their pointwise mutual
information times p(protected), is how strongly the term discloses a person; terms above the threshold are
sensitive, and phrases in the shape of a name that consist of them are removed. Words of trade never get
there, however often they are capitalised.

Every text is matched with the forms once; what that finds is kept (row, kinds, protected terms), and only texts that
hold a term of disclosure are looked at again for names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.sources.tables import checkpointed

#: A term is sensitive when at least this share of its occurrences, and this many, are in protected entities; a phrase with a cue needs the share alone.
DISCLOSURE, SUPPORT = 0.12, 3
#: Sensitive terms that are broadcast; beyond that candidates are joined with them instead.
BROADCAST_TERMS = 500_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_AT = r"(?:\s*[(\[{<]\s*(?:at|ät|arroba|chez)\s*[)\]}>]\s*|\s+at\s+)"
_DOT = r"(?:\s*[(\[{<]\s*(?:dot|punkt|punto|point)\s*[)\]}>]\s*|\s+dot\s+)"
EMAIL = re.compile(r"(?<![\w.+%@/-])[A-Za-z0-9][\w.+%'-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}(?![\w-]|\.\w|:[\w~/])")
SPELLED = re.compile(
    rf"(?<![\w.+@/-])[A-Za-z0-9][\w.+-]*\s*[(\[{{<]\s*(?:at|ät|arroba)\s*[)\]}}>]\s*[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+\b|(?<![\w.+@/-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+\b",
    re.I,
)
#: Signs without one of which SPELLED matches nothing; they are looked for first, as that is much cheaper.
MAY_BE_SPELLED = re.compile(r"[(\[{<]\s*(?:at|ät|arroba|chez|dot|punkt|punto|point)\s*[)\]}>]|\sdot\s", re.I)
REMOTE = re.compile(r"(?:\b(?:ssh|scp|sftp|rsync|mosh)\b[^\n|;&\"']*|://[^\s/@]*)\Z")
PHONE = re.compile(
    r"""(?<![\w./+(-])(?<!\d:)(?:
      (?:\+[1-9]\d{0,2}[ .-]?|00[1-9]\d{0,2}[ .-])(?:\(0?\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,4}
    | \(0?\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,5}
    | \d{3}-\d{3}-\d{4} | \d{3}\.\d{3}\.\d{4} | [2-9]\d{2}\ [2-9]\d{2}\ \d{4}
    | 0\d{3,4}[ ]\d{3}[ ]?\d{3} | 0\d{2,4}[ ]?/[ ]?\d{3,8}(?:[ -]\d{1,5}){0,2}
    | 0[1-9](?:[ .]\d{2}){4} | 0\d{2,4}[ -]\d{5,8}(?:-\d{1,4})? | 0\d{1,3}[ ]\d{3,4}[ ]\d{4}
    )(?![\w/:]|[.-]\w)""",
    re.X,
)
ID_NUMBER = re.compile(
    r"""(?<![\w.-])(?:
      (?:SSN|social\s+security(?:\s+(?:number|no\.?))?)\W{0,3}\d{3}[ -]?\d{2}[ -]?\d{4}
    | \d{3}-\d{2}-\d{4}
    | (?:(?:NI|NINO|national\s+insurance(?:\s+(?:number|no\.?))?)\W{0,3})?[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z]\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]
    | (?:Steuer-?\ ?(?:ID|IdNr\.?|Identifikationsnummer|nummer)|IdNr\.?|tax\s+(?:id|number|no\.?)|TIN|ITIN|NIF|NIE|DNI|CPF|BSN|INSEE|NIR|codice\s+fiscale|ИНН|СНИЛС|マイナンバー)\W{0,3}[A-Z]?\d[\d ./-]{5,18}[\dA-Z]
    | (?:passport|Reisepass|passeport|pasaporte|passaporto|passaporte|paspoort|паспорт|identity\s+card|id\s+card|Personalausweis(?:nummer)?|driving\s+licen[cs]e)\W{0,3}(?:(?:number|no\.?|nr\.?)\W{0,3})?(?=\w*\d{3})[A-Z0-9]{6,12}
    | \d{8}-?[A-HJ-NP-TV-Z] | [XYZ]-?\d{7}-?[A-Z]
    | [12]\ ?\d{2}\ (?:0[1-9]|1[0-2])\ \d{2}\ \d{3}\ \d{3}(?:\ \d{2})?
    | [A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]
    )(?![\w]|-\d)""",
    re.X,
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_PLACE = rf"(?:,\s*(?:\d{{1,2}}[ºª°]\s*[A-Z]\b,?\s*)?(?:\d{{4,5}}\s+)?{_CAP})?"
_ENGLISH = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Terrace|Court|Ct|Drive|Dr|Way|Boulevard|Blvd|Place|Pl|Square|Sq|Gardens|Crescent|Hill|Row|Walk|Mews|Grove|Park|Quay|Rise|View|Parade"
ADDRESS = re.compile(
    rf"""(?<![\w.#/-])(?:
      (?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\ \d+[A-Za-z]?,\ )?\d{{1,5}}[A-Za-z]?\ (?:(?:North|South|East|West|N|S|E|W)\.?\ )?(?!(?:{_ENGLISH})\b)(?:{_CAP}\ ){{1,3}}(?:{_ENGLISH})\b\.?
    | \d{{1,4}}(?:\ ?(?:bis|ter))?,?\ (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)\ (?:(?:de|du|des|la|le|les|l['’])\s?)*{_CAP}(?:[ -](?:de|du|des|la|{_CAP}))*
    | {_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|straat|gracht|laan|plein|kade)\ \d{{1,4}}(?:\ ?[a-z]\b)?
    | (?:{_CAP}[ -]){{1,3}}(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring)\ \d{{1,4}}(?:\ ?[a-z]\b)?
    | (?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Rua|Travessa|Via|Viale|Piazza|Corso|Largo)\ (?:(?:de|del|da|do|das|dos|la|las|los|di|della|degli|dei)\ )*{_CAP}(?:\ (?:de|del|la|las|los|da|do|di|{_CAP}))*,?\ (?:n[.º°]\ ?)?\d{{1,4}}
    | (?:ул\.|улица|проспект|пр\.)\ ?[А-ЯЁ][\w-]*(?:\ [А-ЯЁ][\w-]*)*,?\ (?:д\.\ ?)?\d{{1,4}}
    ){_PLACE}""",
    re.X,
)
LOWER_ADDRESS = re.compile(rf"(?<![\w.#/-])\d{{1,4}} [a-z]+ (?:street|road|lane|avenue|close|terrace|blvd|boulevard|drive|crescent)\b,\s*[A-Za-z]+|\b[a-zäöüß]{{4,}}(?:straße|strasse|str\.|gasse|allee) \d{{1,4}}\b", 0)

#: Parts without one of which LOWER_ADDRESS matches nothing.
LOWER_STREETS = ("street", "road", "lane", "avenue", "close", "terrace", "blvd", "boulevard", "drive", "crescent", "straße", "strasse", "str.", "gasse", "allee")

WORD = re.compile(r"[^\W\d_]{2,}")
_T = r"[^\W\d_]{2,}(?:[-'’][^\W\d_]{2,})*"
_I = r"[^\W\d_]\."
#: given [initial] family | family, given [initial] | initial(s) family
NAME = re.compile(rf"(?<![\w@./\\-])(?:(?P<a>{_T})[  ](?:{_I}[  ]?)?(?P<b>{_T})|(?P<c>{_T}),[  ](?P<d>{_T}|{_I})(?:[  ]{_I})?|(?:{_I}[  ]?){{1,2}}(?P<e>{_T}))(?![\w@\\/]|-\w|\.\w)")
CUE = re.compile(r"(?:author(?:=|:|\s+)|-by:|\bFN:|\"name\":|\bowner:|\bfrom:|\bcc:|\bto:|\bperson:)\s*[\"']?\Z", re.I)
#: Cues that nothing but a person follows; other fields also name teams, steps and places.
AUTHOR = re.compile(r"(?:author[=:]|-by:|\bFN:)\s*[\"']?\Z", re.I)
BOUND = re.compile(r"\A[\s\"',;|:<(\[]{1,4}\Z")
DIGIT = re.compile(r"\d")
FIRST_WORD = re.compile(r"[^\W_]+")
PARTS = re.compile(r"[^\W\d_]{3,}")


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that is found by its form, without overlaps, in order."""
    found: list[tuple[int, int, str]] = []

    def take(pattern: re.Pattern, kind: str) -> None:
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "email" and REMOTE.search(text, 0, a):
                continue
            if not any(a < e and s < b for s, e, _ in found):
                found.append((a, b, kind))

    if "@" in text:
        take(EMAIL, "email")
    if MAY_BE_SPELLED.search(text):
        take(SPELLED, "email")
    if DIGIT.search(text):
        take(ADDRESS, "address")
        if any(word in text for word in LOWER_STREETS):
            take(LOWER_ADDRESS, "address")
        take(ID_NUMBER, "id_number")
        take(PHONE, "phone")
    return sorted(found)


def _plain(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", term.lower()) if c.isalpha())


def own(email: str, terms: list[str]) -> bool:
    """Whether the local part holds one of the terms, or is their initials."""
    local = _plain(_local(email))
    plain = [_plain(t) for t in terms]
    return any(len(t) > 2 and t in local for t in plain) or len(plain) > 1 and local in {"".join(t[:1] for t in plain), "".join(t[:1] for t in reversed(plain))}


def candidates(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, one term, other term or None for an initial) of all name-shaped phrases outside the spans; they may overlap."""
    masked = text
    if taken:
        edges = [0, *(x for a, b, _ in taken for x in (a, b)), len(text)]
        masked = "".join(text[a:b] if i % 2 == 0 else "\x00" * (b - a) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    at = 0
    while m := NAME.search(masked, at):
        a, b = m.span()
        one, other = m["a"] or m["c"] or m["e"], m["b"] or (m["d"] if m["d"] and len(m["d"].rstrip(".")) > 1 else None)
        yield a, b, one, other
        # The next may begin at this one's second word.
        at = FIRST_WORD.match(masked, a).end()


def cue(text: str, taken: list[tuple[int, int, str]], a: int, b: int, terms: list[str]) -> int:
    """What binds the phrase at a:b to a person: 0 nothing, 1 a field or an entity right behind it, 2 an author's field or the person's own e-mail."""
    behind = [(s, e, k) for s, e, k in taken if 0 < s - b <= 4 and BOUND.match(text[b:s])]
    before = text[max(0, a - 16) : a]
    field = (":" in before or "=" in before or "uthor" in before.lower()) and CUE.search(text, max(0, a - 16), a)
    if not (behind or field):
        return 0
    own_mail = any(k == "email" and own(text[s:e], terms) for s, e, k in behind)
    return 2 if own_mail or field and AUTHOR.search(text, max(0, a - 16), a) else 1


def _capital(term: str) -> bool:
    return term[:1].isupper()


def _local(email: str) -> str:
    return re.split(r"@|\s*[(\[{<]|\s", email)[0]


def examine(text: str) -> tuple[set[str], dict[str, int], set[str]]:
    """(kinds of what the text holds for certain, occurrences in protected entities of each term that has any, in lower case, phrases).

    A phrase is a name-shaped one that its terms decide on: term, other term or nothing, and c when it is capitalised, C when it also has a cue; joined by tabs.
    """
    taken = spans(text)
    kinds, guarded, phrases = {k for _, _, k in taken}, Counter(), set()
    for a, b, kind in taken:
        if kind == "email":
            guarded.update(p.lower() for p in PARTS.findall(_local(text[a:b])))
    for a, b, one, other in candidates(text, taken):
        sign = ""
        if _capital(one) and (other is None or _capital(other)):
            terms, sign = [one, other] if other else [one], "c"
            bound = cue(text, taken, a, b, terms)
            if bound:
                guarded.update(p.lower() for t in terms for p in PARTS.findall(t))
                sign = "C"
            if bound == 2:
                kinds.add("name")
        if other or sign:
            phrases.add(f"{one}\t{other or ''}\t{sign}".lower() if sign != "C" else f"{one}\t{other or ''}\t".lower() + "C")
    if guarded:
        every = Counter(w.lower() for w in WORD.findall(text))
        guarded = {t: min(every[t], n) for t, n in guarded.items() if every[t]}
    return kinds, guarded, set() if "name" in kinds else phrases


def decided(phrases: Iterable[str], terms: set[str], rare: set[str]) -> bool:
    """Whether one of the phrases is a name; the same rule as named() has."""
    for phrase in phrases:
        one, other, sign = phrase.split("\t")
        first, second = _sensitive(one, terms), bool(other) and _sensitive(other, terms)
        if first and (second if other else True) or sign == "C" and (first or second or _sensitive(one, rare) or bool(other) and _sensitive(other, rare)):
            return True
    return False


class Memo(dict):
    """Results for short texts that a task has just met; commands and messages repeat."""

    def __init__(self, fn: Callable, longest: int = 4_000, most: int = 20_000):
        super().__init__()
        self.fn, self.longest, self.most = fn, longest, most

    def __call__(self, text: str):
        if len(text) > self.longest:
            return self.fn(text)
        got = self.get(text)
        if got is None:
            if len(self) >= self.most:
                self.clear()
            got = self[text] = self.fn(text)
        return got


KEYS = ["tbl", "row_id", "field"]


def _mapped(texts: DataFrame, fn: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (tbl, row_id, field, *columns of `schema`) of what `fn` makes of each text; a task remembers short texts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    typed = _parse_datatype_string("tbl string, row_id bigint, field string, " + schema)
    arrow = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(fn)
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for found in known(text) if text else ():
                    at.append(i)
                    out.append(found)
            if out:
                keys = [c.take(pa.array(at)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t.type) for c, t in zip(zip(*out), list(arrow)[3:]))], schema=arrow)

    return texts.select(*KEYS, "text").mapInArrow(run, typed)


def _examined(text: str) -> list[tuple]:
    kinds, guarded, phrases = examine(text)
    return [(list(kinds), list(guarded.items()), list(phrases))] if kinds or guarded or phrases else []


def survey(texts: DataFrame) -> DataFrame:
    """(tbl, row_id, field, kinds, terms, phrases): what the forms find in each text, the terms they protect, and the phrases that terms decide on; written once."""
    return checkpointed(_mapped(texts, _examined, "kinds array<string>, terms map<string,bigint>, phrases array<string>"))


def _by_term(rows: DataFrame, name: str) -> DataFrame:
    """(term, name): counts of the terms over the rows, each row once whatever its deliveries."""
    return rows.groupBy(*KEYS, "term").agg(F.max("k").alias("k")).groupBy("term").agg(F.sum("k").alias(name))


def disclosure(texts: DataFrame, seen: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """(term, n, guarded, share) of the terms that disclose a person, from all texts; `seen` is their survey().

    Only terms that are protected anywhere are counted elsewhere, so (row, term) pairs of those few are shuffled. More than `limit` of them are joined.
    """
    guarded = checkpointed(_by_term(seen.select(*KEYS, F.explode("terms").alias("term", "k")), "guarded"))
    few = guarded.select("term").limit(limit + 1).collect()
    shared = texts.sparkSession.sparkContext.broadcast({r.term for r in few}) if len(few) <= limit else None

    def every(text: str) -> list[tuple[str, int]]:
        words = WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]
        return list(Counter(words if shared is None else filter(shared.value.__contains__, words)).items())

    table = guarded.join(_by_term(_mapped(texts, every, "term string, k bigint"), "n"), "term")
    return table.withColumn("share", F.col("guarded") / F.col("n")).where(F.col("share") >= DISCLOSURE).select("term", "n", "guarded", "share")


def _sensitive(term: str, terms: set[str]) -> bool:
    t = term.lower()
    return t in terms or ("-" in t or "'" in t or "’" in t) and any(p in terms for p in PARTS.findall(t))


def named(text: str, taken: list[tuple[int, int, str]], terms: set[str], rare: set[str]) -> list[tuple[int, int, str]]:
    """Spans of the names in a text. `terms` are sensitive, `rare` have the share but not the support, which only counts beside a cue."""
    out: list[tuple[int, int, str]] = []
    for a, b, one, other in candidates(text, taken):
        if out and a < out[-1][1]:
            continue
        capital = _capital(one) and (other is None or _capital(other))
        if _sensitive(one, terms) and (capital if other is None else _sensitive(other, terms)):
            out.append((a, b, "name"))
        elif capital:
            both = [one, other] if other else [one]
            bound = cue(text, taken, a, b, both)
            if bound == 2 or bound == 1 and any(_sensitive(t, terms) or _sensitive(t, rare) for t in both):
                out.append((a, b, "name"))
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its placeholder."""
    for a, b, kind in sorted(found, reverse=True):
        text = text[:a] + PLACEHOLDERS[kind] + text[b:]
    return text


def gather(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(tbl, row_id, field, text) of all fields; null texts hold nothing and are left out."""
    out = None
    for (tbl, field), df in tables.items():
        part = df.where(df[field].isNotNull()).select(F.lit(tbl).alias("tbl"), df["row_id"], F.lit(field).alias("field"), df[field].alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def _terms(texts: DataFrame, seen: DataFrame, limit: int) -> tuple[DataFrame, tuple[set[str], set[str]] | None]:
    """The terms (term, sensitive), and both kinds as sets, if there are few enough to broadcast."""
    table = checkpointed(disclosure(texts, seen, limit).select("term", (F.col("guarded") >= SUPPORT).alias("sensitive")))
    rows = table.limit(limit + 1).collect()
    return table, None if len(rows) > limit else ({r.term for r in rows if r.sensitive}, {r.term for r in rows if not r.sensitive})


def find(texts: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """(tbl, row_id, field, kind), distinct: the field holds at least one item of that kind.

    Repeated deliveries give one row; empty texts none. The texts are never shuffled unless the terms are too many.
    """
    seen = survey(texts)
    table, terms = _terms(texts, seen, limit)
    certain = seen.select(*KEYS, F.explode("kinds").alias("kind"))
    phrases = seen.where(F.size("phrases") > 0).select(*KEYS, "phrases")
    if terms is None:
        names = _names_by_join(phrases, table)
    else:
        shared = texts.sparkSession.sparkContext.broadcast(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _kept(batch, [decided(p, *shared.value) for p in batch.column(3).to_pylist()])

        names = phrases.mapInArrow(run, FOUND)
    return certain.unionByName(names).distinct()


FOUND = "tbl string, row_id bigint, field string, kind string"


def _kept(batch: pa.RecordBatch, hit: list[bool]) -> pa.RecordBatch:
    """The keys of a batch's rows that hold a name."""
    rows = batch.select([0, 1, 2]).filter(pa.array(hit, pa.bool_()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(["name"] * len(rows), pa.string())], names=[*KEYS, "kind"])


def _terms_of(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(tbl, row_id, field, terms, rare): which of a row's words are terms of disclosure; `rows` has (tbl, row_id, field, word)."""
    hits = rows.distinct().join(table, rows["word"] == table["term"])
    return hits.groupBy(*KEYS).agg(F.collect_list(F.when(F.col("sensitive"), F.col("term"))).alias("terms"), F.collect_list(F.when(~F.col("sensitive"), F.col("term"))).alias("rare"))


def _names_by_join(phrases: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with a name, without a broadcast: the words of every phrase are joined with the terms."""
    both = F.flatten(F.transform("phrases", lambda p: F.slice(F.split(p, "\t"), 1, 2)))
    words = F.array_union(both, F.flatten(F.transform(both, lambda t: F.regexp_extract_all(t, F.lit(r"\p{L}{3,}"), F.lit(0)))))
    sets = _terms_of(phrases.select(*KEYS, F.explode(words).alias("word")), table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept(batch, [decided(p, set(terms), set(rare)) for p, terms, rare in zip(*[c.to_pylist() for c in batch.columns[3:]])])

    return phrases.join(sets, KEYS).mapInArrow(run, FOUND)


def _with_terms(texts: DataFrame, table: DataFrame) -> DataFrame:
    """The texts with the terms that name-shaped phrases of each consist of, sensitive ones and others; instead of a broadcast."""

    def words(text: str) -> list[tuple[str]]:
        return [(w,) for w in {w for _, _, one, other in candidates(text, spans(text)) for t in (one, other) if t for w in (t.lower(), *PARTS.findall(t.lower()))}]

    return texts.select(*KEYS, "text").join(_terms_of(_mapped(texts, words, "word string"), table), KEYS, "left")


CLEAN = "tbl string, row_id bigint, field string, text string"


def _sanitise_by_join(texts: DataFrame, table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for text, terms, rare in zip(*[c.to_pylist() for c in batch.columns[3:]]):
                taken = spans(text)
                clean.append(redact(text, taken + named(text, taken, set(terms or ()), set(rare or ()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(clean, pa.string())], names=[*KEYS, "text"])

    return _with_terms(texts, table).mapInArrow(run, CLEAN)


def sanitise(texts: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """(tbl, row_id, field, text) with typed placeholders; every row stays, once for each delivery."""
    table, terms = _terms(texts, survey(texts), limit)
    if terms is None:
        return _sanitise_by_join(texts, table)
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            clean = []
            for text in batch.column(3).to_pylist():
                taken = spans(text)
                clean.append(redact(text, taken + named(text, taken, *known)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(clean, pa.string())], names=["tbl", "row_id", "field", "text"])

    return texts.mapInArrow(run, CLEAN)
