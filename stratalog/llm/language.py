"""A language for each document and each passage, with a confidence.

Method: word-first backoff. A known word scores by its log frequency in each language; an unseen word falls
back to its character n-grams, from the longest known ones to shorter ones. Code, commands, logs, tables,
paths and the like are set aside first; what is left is cut into sentences and list items, each gets a
language, and neighbours in one language form a passage, which has a place in the text. Units most of whose words
neither the words nor the longer n-grams of any of the languages know are of another language ("other").

The model is fitted on a bounded, hash-chosen sample of labelled documents (SAMPLE a language). Labels are
wrong at times, so the sample's sentences are labelled anew by the model and it is fitted again. A fifth of the
sample is held out of a first fit; on it the confidence's scale is set, and accuracy is measured.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "ja")
#: Labelled documents a language that the model is fitted on at most (about), rounds of fitting, longest n-gram.
SAMPLE, ROUNDS, LONGEST = 600, 3, 4
#: Every how-many-th sampled document is held out to set the confidence's scale; scales that are tried.
HELD_OUT, SCALES = 5, tuple(2 ** (i / 2) for i in range(-2, 15))
#: Words of a unit that fall back below n-grams of this length are strange; a unit of which more than this share is strange is in OTHER.
FAMILIAR, STRANGE, OTHER = 4, 0.6, "other"
#: Least chance and fewest words of a unit that has a language; scripts without blanks count letters alone.
SURE, LEAST_WORDS, LEAST_LETTERS = 0.7, 5, 8
#: Longest text, in characters, that the sample takes: with SAMPLE it bounds what the driver is sent.
LONG = 50_000
#: Frequency that anything has in every language: the same for all, so a language with little text gains nothing by it.
FLOOR = 1e-5
#: Names of the languages in themselves and in English, and three-letter codes.
NAMES = {
    "en": "en eng english englisch anglais inglés inglese inglês",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "it": "it ita italian italiano italienisch",
    "nl": "nl nld dut dutch nederlands niederländisch flemish vlaams",
    "ru": "ru rus russian русский russisch",
    "ja": "ja jpn jp japanese 日本語 japanisch",
}
BY_NAME = {name: lang for lang, names in NAMES.items() for name in names.split()}


def named(label: Column) -> Column:
    """The language a label names, whatever its spelling; null when it names none of LANGUAGES."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}]+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in BY_NAME.items() for x in pair])
    # A code stands first (de-AT); a name may have others before it (Brazilian Portuguese).
    told = F.transform(words, lambda w, i: F.when((i == 0) | (F.length(w) > 3), F.try_element_at(table, w)))
    return F.try_element_at(F.array_compact(told), F.lit(1))


FENCE = re.compile(r"^[ \t>]*(```|~~~)")
ITEM = re.compile(r"^[ \t>]*(?:[-*+•·‣–]|\d{1,3}[.)]|\[[ xX]\])\s+(?=\S)")
QUOTE = re.compile(r"^[ \t]*>+ ?|^[ \t]*\d{1,4}[ \t]*[|:][ \t]?")
NOT_TEXT = re.compile(
    r"^\s*(?:\#{1,6}\s|\||\$ |> \$|={3,}|-{3,}|\+{3,}|@@|[\[{(}\])]*$|[\"']?[\w.-]+[\"']?\s*[:=]\s*[\[{\"'\d]|[{\[]|\}|</?\w|//|/\*|\d{4}-\d\d-\d\d[T ]|\[\d{4}-|\d\d:\d\d|(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b|at .+[(:]\d+|Traceback|import |from \S+ import|def |class |function |const |let |var |return\b|export |#!|[-+]\t|\w[\w.]*(?:\s*=\s*\S|[({]\S))"
)
JSON_TEXT = re.compile(r"\"(?:input|text|content|prompt|body)\"\s*:\s*\"((?:\\.|[^\"\\])*)\"")
HTML_LINE = re.compile(r"^\s*</?(?:p|b|i|em|strong|li|ul|ol|div|span|blockquote|br|h\d)\b", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: Japanese has no blanks, so the runs of INLINE that end at one stop at its letters and signs too.
_RUN = r"[^\s\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff00-\uffef]"
#: Inline code and links, which may hold blanks; a link's text stays.
SPANS = re.compile(r"```[^`]*```|`[^`\n]*`|\[\[[^\]\n]*\]\]|!?\[([^\]\n]*)\]\([^)\n]*\)")
#: What is no word, in a piece without blanks: addresses, paths, file names, names in code.
INLINE = re.compile(r"https?://" + _RUN + r"+|data:" + _RUN + r"+|" + _RUN + r"{60,}|\b[\w.+-]+@[\w.-]+\b|(?<![\w])[@~.]?/?(?:[\w.-]+/)+[\w.-]*|\b\w+\.(?:py|ts|tsx|js|go|rs|md|json|sql|yml|yaml|txt|sh|toml|log)\b|\b[a-z0-9]+(?:[A-Z][a-z0-9]*)+\b|\b\w+_\w+\b|\b[a-z]+-[a-z]+(?=\b)|@\S+|#\d+")
STOP = re.compile(r"(?<=[.!?;])[\"'»”)\]*_]*\s+(?=[^\W\d_]|[\"'«“(¿¡*_\d`\[@])|(?<=[。！？])")
LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
FRONT = re.compile(r"\A\s*---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CJK = re.compile(r"[぀-ヿ㐀-鿿々ー]")


def placed_units(text: str | None) -> list[tuple[str, int, int]]:
    """(unit, start, end) of the sentences and list items of a text, in order, without what has no language.

    start and end are places in the text as delivered; where a line's tags or quote signs were taken away they are its line's.
    """
    if not text or text.isspace():
        return []
    front = FRONT.match(text)
    out: list[tuple[str, int, int]] = []
    # Lines of the open paragraph: where each begins in the joined text, and its (begin, end, whether it is unchanged) in the whole one.
    pieces: list[str] = []
    places: list[tuple[int, int, int, bool]] = []

    def close() -> None:
        if not pieces:
            return
        joined, begins = " ".join(pieces), [p[0] for p in places]

        def place(at: int, end: bool) -> int:
            begin, a, b, same = places[bisect_right(begins, at - end) - 1]
            return min(a + at - begin, b) if same else b if end else a

        last = 0
        for cut in [*(m.span() for m in STOP.finditer(joined)), (len(joined), len(joined))]:
            # What closes a quotation belongs to the sentence before the cut, as in STOP.split.
            unit = joined[last : cut[0]]
            if unit.strip():
                out.append((unit, place(last, False), place(cut[0], True)))
            last = cut[1]
        pieces.clear()
        places.clear()

    def add(line: str, a: int, b: int, whole: str) -> None:
        """A piece of the paragraph: `whole` is the line at a:b of which `line` is left."""
        line = line.strip()
        at = whole.find(line)
        same = at >= 0 and bool(line)
        places.append((sum(map(len, pieces)) + len(pieces), a + at if same else a, a + at + len(line) if same else b, same))
        pieces.append(line)

    fence = None
    for m in LINE.finditer(text, front.end() if front else 0):
        a, b = m.span(1)
        line = whole = m[1].replace("\u00a0", " ")
        mark = FENCE.match(line)
        if fence:
            fence = None if mark and mark[1] == fence else fence
            continue
        if mark:
            close()
            fence = mark[1]
            continue
        inner = JSON_TEXT.search(line) if line.lstrip().startswith("{") else None
        if inner:
            close()
            body = inner[1].replace("\\n", "\n").replace("\\\"", "\"")
            body = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), body)
            out.extend((s, a + inner.start(1), a + inner.end(1)) for s in STOP.split(body.replace("\n", " ")) if s.strip())
            continue
        line = QUOTE.sub("", line)
        if HTML_LINE.match(line):
            close()
        elif not line.strip() or NOT_TEXT.match(line) or line.startswith(("    ", "\t")) and not ITEM.match(line):
            close()
            continue
        line = TAG.sub("", line)
        item = ITEM.match(line)
        if item:
            close()
            add(line[item.end() :], a, b, whole)
            close()
        else:
            add(line, a, b, whole)
    close()
    return out


def units(text: str | None) -> list[str]:
    """The units alone."""
    return [u for u, _, _ in placed_units(text)]


def _words(piece: str) -> list[str]:
    """Lower-case words of a piece without blanks; runs of ideographs and kana are cut in pairs."""
    if piece.isalpha() and piece.isascii() and (piece[1:].islower() or piece.isupper() or len(piece) == 1) and len(piece) < 60:
        return [piece.lower()]
    plain = INLINE.sub(" ", piece)
    found = WORD.findall(plain.lower())
    if not CJK.search(plain):
        return found
    return [p for w in found for p in ([w[i : i + 2] for i in range(0, len(w), 2)] if CJK.search(w) else [w])]


def pieces(unit: str) -> list[str]:
    """A unit cut at blanks, inline code taken out."""
    return (SPANS.sub(lambda m: m[1] or " ", unit) if "`" in unit or "[" in unit else unit).split()


def tokens(unit: str) -> list[str]:
    """Lower-case words of a unit, inline code, paths and names left out."""
    return [w for p in pieces(unit) for w in _words(p)]


def _grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and of n-grams, a row each and a column a language; `scale` divides scores before they are chances."""

    def __init__(self, words: dict[str, int], word_scores: np.ndarray, grams: dict[int, tuple[dict[str, int], np.ndarray]], scale: float = 1.0):
        self.words, self.word_scores, self.grams, self.scale = words, word_scores, grams, scale
        self.held_out: tuple[int, float] = (0, 0.0)  # held-out units, share of them that got their document's language

    def word(self, w: str) -> tuple[np.ndarray, bool]:
        """(scores of a word, whether it is strange), centred so that a word tells languages apart and nothing else."""
        row = self.words.get(w)
        if row is not None:
            got, strange = self.word_scores[row], False
        else:
            got, strange = np.zeros(len(LANGUAGES)), True
            for n in range(min(LONGEST, len(w) + 2), 0, -1):
                rows, table = self.grams.get(n, ({}, None))
                every = _grams(w, n)
                known = [rows[g] for g in every if g in rows]
                if known and 2 * len(known) >= len(every):
                    got, strange = table[known].mean(axis=0) * 1.5, n < FAMILIAR
                    break
        return got - got.max(), strange


class Scorer:
    """Scores units by batch: pieces already met are rows of one matrix, a batch is one gather and one sum a unit."""

    #: Columns behind the languages.
    N_WORDS, N_LETTERS, N_STRANGE, N_CJK = range(len(LANGUAGES), len(LANGUAGES) + 4)

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most, self.words = model, most, {}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES) + 4))

    def _row(self, piece: str) -> np.ndarray:
        row = np.zeros(self.rows.shape[1])
        for w in _words(piece):
            score, strange = self.model.word(w)
            row[: len(LANGUAGES)] += score
            row[len(LANGUAGES) :] += 1, len(w), strange, bool(CJK.search(w))
        return row

    def sums(self, units: list[str]) -> np.ndarray:
        """A row a unit: summed scores, words, letters, strange words, words in a script without blanks."""
        if len(self.ids) > self.most:
            self._forget()
        ids, starts = [], []
        for unit in units:
            starts.append(len(ids))
            for p in pieces(unit):
                at = self.ids.get(p)
                if at is None:
                    at = self.ids[p] = len(self.ids) + 1  # row 0 stays empty
                    if at >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[at] = self._row(p)
                ids.append(at)
            ids.append(0)
        return np.add.reduceat(self.rows[ids], starts) if starts else np.zeros((0, self.rows.shape[1]))


def chances(scores: np.ndarray) -> np.ndarray:
    """Rows of scores as confidences that sum to one."""
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def judge(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each unit's language, scores): len(LANGUAGES) is another language, -1 a phrase too short or of no language."""
    s, n = scorer.sums(texts), len(LANGUAGES)
    scores = s[:, :n]
    at = scores.argmax(axis=1) if len(s) else np.zeros(0, int)
    long = (s[:, Scorer.N_LETTERS] >= LEAST_LETTERS) & ((s[:, Scorer.N_WORDS] >= LEAST_WORDS) | (s[:, Scorer.N_CJK] > 0))
    other = (s[:, Scorer.N_STRANGE] > STRANGE * s[:, Scorer.N_WORDS]) & bool(scorer.model.words)  # an empty model knows nothing strange
    sure = chances(scores).max(axis=1, initial=0.0) >= SURE
    return np.where(~long, -1, np.where(other, n, np.where(sure, at, -1))), scores


def _fit(sentences: list[list[str]], labels: np.ndarray) -> tuple[Model, np.ndarray]:
    """A model of the sentences and the labels it gives them; the labels told only start it off."""
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws in sentences for w in ws], int)
    lengths = np.array([len(ws) for ws in sentences], int)
    starts, of = np.concatenate([[0], lengths.cumsum()[:-1]]).astype(int), np.repeat(np.arange(len(sentences)), lengths)
    tables = {}
    for n in range(1, LONGEST + 1):
        rows: dict[str, int] = {}
        pairs = [(row, rows.setdefault(g, len(rows))) for w, row in vocabulary.items() for g in _grams(w, n)]
        tables[n] = (rows, np.array(pairs, int).reshape(-1, 2))
    model = Model({}, np.zeros((0, len(LANGUAGES))), {})
    for _ in range(ROUNDS):
        counts = np.zeros((len(vocabulary), len(LANGUAGES)))
        np.add.at(counts, (ids, labels[of]), 1)
        logs = lambda c: np.log(c / (c.sum(axis=0) + 1e-9) + FLOOR)
        grams = {}
        for n, (rows, pairs) in tables.items():
            c = np.zeros((len(rows), len(LANGUAGES)))
            np.add.at(c, pairs[:, 1], counts[pairs[:, 0]])
            often, table = c.sum(axis=1) >= 2, logs(c)
            grams[n] = ({g: row for g, row in rows.items() if often[row]}, table)
        often = counts.sum(axis=1) >= 2
        model = Model({w: row for w, row in vocabulary.items() if often[row]}, logs(counts), grams)
        scores = np.array([model.word(w)[0] for w in vocabulary]).reshape(-1, len(LANGUAGES))
        labels = np.add.reduceat(scores[ids], starts).argmax(axis=1)
    return model, labels


def fit(rows: list[tuple[str | None, str]]) -> Model:
    """From (text, language) rows; the labels only start it off. The confidence's scale is the one of SCALES that gives held-out labels the most likelihood."""
    met: dict[str, list[str]] = {}

    def words(unit: str) -> list[str]:
        return [w for p in pieces(unit) for w in (met.get(p) or met.setdefault(p, _words(p)))]

    sentences = [(ws, LANGUAGES.index(lang), doc) for doc, (text, lang) in enumerate(rows) for u in units(text) if len(ws := words(u)) >= 3]
    if not sentences:
        return Model({}, np.zeros((0, len(LANGUAGES))), {})
    told = np.array([label for _, label, _ in sentences])
    model, _ = _fit([ws for ws, _, _ in sentences], told)
    out = np.array([doc % HELD_OUT == 0 for _, _, doc in sentences])
    if out.any() and not out.all():
        first, _ = _fit([s[0] for s, o in zip(sentences, out) if not o], told[~out])
        scores = Scorer(first).sums([" ".join(s[0]) for s, o in zip(sentences, out) if o])[:, : len(LANGUAGES)]
        got, docs = scores.argmax(axis=1), np.array([s[2] for s, o in zip(sentences, out) if o])
        # Documents with a wrong label, or in several languages, measure nothing: most units must be in the language told.
        agree = np.bincount(docs, got == told[out]) > 0.8 * np.maximum(np.bincount(docs), 1)
        scores, truth = scores[agree[docs]], told[out][agree[docs]]
        if len(truth):
            loss = {scale: -np.log(chances(scores / scale)[np.arange(len(truth)), truth] + 1e-12).mean() for scale in SCALES}
            model.scale = min(loss, key=loss.get)
            model.held_out = (len(truth), float((scores.argmax(axis=1) == truth).mean()))
    return model


def train(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about `sample` labelled documents a language, chosen by a hash of doc_id.

    What is collected is bounded by sample x languages rows, whatever the corpus; their number is checked.
    """
    labelled = documents.select("doc_id", "text", named(F.col("lang")).alias("_lang")).where(F.col("_lang").isNotNull() & (F.length("text") <= LONG))
    counts = {r._lang: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("_lang")] * (1 << 20))
    rows = chosen.select("text", "_lang").limit(2 * sample * len(LANGUAGES)).collect()
    return fit(sorted((r.text, r._lang) for r in rows))


PASSAGES = "doc_id bigint, passage int, lang string, units int, start int, end int, confidence double"


def _runs(judged: Iterable[tuple[int, np.ndarray, int, int]]) -> list[list]:
    """[language number, units, summed scores, start, end] of neighbouring units in one language."""
    got: list[list] = []
    for at, score, start, end in judged:
        if got and got[-1][0] == at:
            run = got[-1]
            run[1], run[2], run[4] = run[1] + 1, run[2] + score, end
        else:
            got.append([at, 1, score, start, end])
    return got


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, passage number, lang, units, start, end, confidence): neighbouring sentences and items of one language.

    start and end are character places in the text. lang is one of LANGUAGES or OTHER, whose confidence is null. Units without a
    language don't end a passage. Null, empty and blank texts, and those of code alone, have no passage.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [*LANGUAGES, OTHER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            docs = [(doc, placed_units(text)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            at, scores = judge(scorer, [u for _, found in docs for u, _, _ in found])
            out, i = [], 0
            for doc, found in docs:
                mine = range(i, i + len(found))
                i += len(found)
                for k, (lang, n, score, start, end) in enumerate(_runs((at[j], scores[j], found[j - mine.start][1], found[j - mine.start][2]) for j in mine if at[j] >= 0)):
                    sure = None if lang == len(LANGUAGES) else round(float(chances(score / (scorer.model.scale * n**0.5))[lang]), 4)
                    out.append((doc, k, names[lang], n, start, end, sure))
            if out:
                columns = zip(*out)
                types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in PASSAGES.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, PASSAGES)


def document_languages(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row a document: the language most units are in (ties: by name), the mean confidence of those units times their share of all as confidence; nulls when it has none."""
    by = found.groupBy("doc_id", "lang").agg(F.sum("units").alias("n"), F.sum(F.col("units") * F.col("confidence")).alias("sure"))
    best = by.groupBy("doc_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by("sure", F.struct("n", "lang")).alias("sure"), F.sum("n").alias("all"))
    return documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", "lang", F.round(F.col("sure") / F.col("all"), 4).alias("confidence"))


def mislabelled(documents: DataFrame, model: Model, least: int = 2) -> DataFrame:
    """(doc_id, lang) where a passage of `least` units or more is in a language that the label doesn't name; distinct."""
    labels = documents.select(F.col("doc_id"), named(F.col("lang")).alias("label"))
    found = passages(documents, model).where((F.col("units") >= least) & (F.col("lang") != OTHER)).select("doc_id", "lang").distinct()
    return found.join(labels, "doc_id").where("label is null or label <> lang").select("doc_id", "lang").distinct()
