"""Evaluation texts inside training documents.

Method: Wu-Manber multi-pattern search over words. Every window of SEED words of a test item is a pattern; a
table of two-word blocks says how far the scan may jump, blocks that end a pattern lead to a bucket of
patterns, and the words are compared directly. With one change in eight allowed, 20 words hold a run
of six unchanged ones at least, so windows of five lose nothing. Around a seed the passage is then grown
both ways with an edit distance over words, which decides.

What doesn't count is taken away first: case, punctuation, escapes, entities, markup, quoting, line numbers.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.sources.tables import checkpointed

LEAST, ONE_IN, SEED, BLOCK = 20, 8, 5, 2
#: Bytes that a searcher takes for each character of its items, measured (a test holds it), and the memory that a portion of items may
#: take in each Python worker; more items are searched for in further passes, one after another.
BYTES_A_CHARACTER, PORTION_BYTES = 64, 256 << 20
AT_ONCE = PORTION_BYTES // BYTES_A_CHARACTER

ESCAPES = re.compile(r"\\+u([0-9a-fA-F]{4})|\\+[nrt](?![a-z]{2,}\.)|\\+(?=[\"'`*_\[\]()#>~|.!-])")
TAGS = re.compile(r"<(/?)(p|br|li|ul|ol|div|td|tr|th|table|h[1-6]|hr|blockquote|pre)\b[^<>]*>|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", re.I)
LINKS = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
NUMBERED = re.compile(r"(?m)^[ \t>]*\d+[ \t]*(?:[|:]|→|\t|[.)](?=[ \t]))")
PLAIN_NUMBERED = re.compile(r"(?m)^[ \t]*(\d+) +(?=\S)")
APOSTROPHES = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")
HYPHENS = re.compile(r"(?<=[^\W\d_])[-‐]\n[ \t>]*(?=[^\W\d_A-Z])")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
WORDS = re.compile(r"[^\W_]+")


def _surrogates(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _unnumber(text: str) -> str:
    """Bare numbers at line starts go only where they count upwards line by line."""
    found = list(PLAIN_NUMBERED.finditer(text))
    drop = [m for i, m in enumerate(found) if any(0 <= j < len(found) and int(found[j][1][-9:]) - int(m[1][-9:]) == j - i for j in (i - 1, i + 1)) and len(found) > 2]
    for m in reversed(drop):
        text = text[: m.start()] + text[m.end() :]
    return text


def words(text: str | None) -> list[str]:
    """The words that count, in order."""
    if not text:
        return []
    if "\\" in text:
        text = _surrogates(ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n" if m[0][-1] in "nrt" else "", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAGS.sub(lambda m: " " if m[2] else "", text)
    if "](" in text:
        text = LINKS.sub("", text)
    if "\n" in text:
        text = HYPHENS.sub("", NUMBERED.sub(" ", text))
        text = _unnumber(text)
    text = re.sub(r"[*_~`]{1,3}(?=\w)|(?<=\w)[*_~`]{1,3}", "", text) if re.search(r"[*_~`]", text) else text
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return WORDS.findall(APOSTROPHES.sub("", text).casefold())


class Searcher:
    """Wu-Manber tables of all SEED-word windows of the items, and the items themselves.

    Items are one array of word numbers; windows are its places, sorted by a hash of their words, so a bucket is a range
    of two flat arrays. The shift table has an entry a pair of words. Measured: BYTES_A_CHARACTER of the items' text.
    """

    def __init__(self, items: list[tuple[int | None, str | None]]):
        vocabulary: dict[str, int] = {}
        self.names: list[int | None] = []
        kept = []
        for item, text in items:
            ws = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            if len(ws) >= LEAST:
                self.names.append(item)
                kept.append(np.array(ws, np.int32))
        self.vocabulary, self.unknown = vocabulary, len(vocabulary)
        self.offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64)
        self.flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
        starts = np.concatenate([np.arange(a, b - SEED + 1) for a, b in zip(self.offsets, self.offsets[1:])]) if kept else np.zeros(0, np.int64)
        hashes = np.fromiter(map(hash, zip(*[self.flat[starts + i].tolist() for i in range(SEED)])), np.int64, len(starts))
        order = np.argsort(hashes, kind="stable")
        hashes, self.starts = hashes[order], starts[order].astype(np.int32 if len(self.flat) < 1 << 31 else np.int64)
        begins = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] - 1)) if len(hashes) else np.zeros(0, int)
        self.ends = np.append(begins[1:], len(hashes)).astype(self.starts.dtype)
        self.begins = begins.astype(self.starts.dtype)
        self.bucket: dict[int, int] = dict(zip(hashes[begins].tolist(), range(len(begins))))
        self.shift: dict[int, int] = {}
        for end in range(BLOCK, SEED + 1):
            left, right = (self.flat[starts + end - i].astype(np.int64) for i in (2, 1))
            # Later ends have the smaller shift and overwrite earlier ones.
            self.shift.update(zip(np.unique(left * (self.unknown + 1) + right).tolist(), repeat(SEED - end)))

    def _places(self, bucket: int, window: tuple[int, ...]) -> list[int]:
        """Places in `flat` of a window of words, from its bucket; the words themselves are compared."""
        return [p for p in self.starts[self.begins[bucket] : self.ends[bucket]].tolist() if tuple(self.flat[p : p + SEED].tolist()) == window]

    def seeds(self, ws: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(position, places in the items) of every window of the document that is a pattern."""
        at, shift, far, width, buckets = SEED - 1, self.shift, SEED - BLOCK + 1, self.unknown + 1, self.bucket
        while at < len(ws):
            jump = shift.get(ws[at - 1] * width + ws[at], far)
            if jump == 0:
                window = tuple(ws[at - SEED + 1 : at + 1])
                bucket = buckets.get(hash(window))
                if bucket is not None and (hit := self._places(bucket, window)):
                    yield at - SEED + 1, hit
                jump = 1
            at += jump

    def leaks(self, text: str | None) -> list[int | None]:
        """Names of the items of which the text holds a passage."""
        ws = [self.vocabulary.get(w, self.unknown) for w in words(text)]
        found: set[int] = set()
        seen: set[tuple[int, int]] = set()
        items: dict[int, list[int]] = {}
        for q, places in self.seeds(ws):
            for place in places:
                i = int(np.searchsorted(self.offsets, place, "right")) - 1
                if i in found:
                    continue
                begin = int(self.offsets[i])
                p = place - begin
                if i not in items:
                    items[i] = self.flat[begin : self.offsets[i + 1]].tolist()
                # A seed that goes on from the one before it, in the same item, was judged with it.
                goes_on = (i, place - q) in seen and p and q and items[i][p - 1] == ws[q - 1]
                seen.add((i, place - q))
                if not goes_on and passage(items[i], ws, p, q):
                    found.add(i)
        return [self.names[i] for i in sorted(found)]


def growth(item: list[int], doc: list[int], most: int) -> list[int]:
    """growth[x]: fewest edits between the first x words of `item` and some beginning of `doc`; ends once all exceed `most`."""
    width = min(len(doc), len(item) + most)
    row = list(range(min(width, most) + 1)) + [most + 1] * max(0, width - most)
    out = [0]
    for x, w in enumerate(item, 1):
        lo, hi = max(1, x - most), min(width, x + most)
        left = x if lo == 1 else most + 1
        diagonal = row[lo - 1]
        if lo == 1:
            row[0] = x
        else:
            row[lo - 1] = most + 1
        best = left if lo == 1 else most + 1
        for y in range(lo, hi + 1):
            up = row[y]
            value = diagonal if doc[y - 1] == w else 1 + min(diagonal, up, left)
            diagonal, left = up, value
            row[y] = value
            if value < best:
                best = value
        if best > most:
            break
        out.append(best)
    return out


def passage(item: list[int], doc: list[int], p: int, q: int) -> bool:
    """Whether the seed at item[p:], doc[q:] lies in a passage long and like enough."""
    most = len(item) // ONE_IN
    span = len(item) + most
    right = growth(item[p + SEED :], doc[q + SEED : q + SEED + span], most)
    left = growth(item[:p][::-1], doc[max(0, q - span) : q][::-1], most)
    for y, e in enumerate(left):
        for x in range(max(0, LEAST - SEED - y), len(right)):
            if e + right[x] <= (x + y + SEED) // ONE_IN:
                return True
    return False


#: The worker's searcher and the broadcast it was built from; tasks of the same search share it.
_BUILT: dict[str, Searcher] = {}


def _searcher(key: str, items: Callable[[], list]) -> Searcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Searcher(items())
    return _BUILT[key]


def find_leaks(documents: DataFrame, eval_items: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, item_id), distinct: the document holds a passage of LEAST words or more of the item.

    Items are collected and broadcast in portions of at most about `at_once` characters (their total is measured first). Of
    several portions each is searched for and written before the next is fetched, so a larger test set takes more passes, not
    more memory; documents are never shuffled. Null, empty and too short texts neither leak nor are leaked; repeated item ids
    count as one; a null id is an id.
    """
    spark = documents.sparkSession
    total = eval_items.agg(F.sum(F.length("text"))).first()[0] or 0
    portions = -(-total // at_once) or 1
    found = None
    for portion in range(portions):
        part = eval_items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == portion) if portions > 1 else eval_items
        rows = sorted({(r.item_id, r.text) for r in part.select("item_id", "text").collect() if r.text}, key=repr)
        shared, key = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(key, lambda: shared.value)
            for batch in batches:
                pairs = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in searcher.leaks(t)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        part = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint")
        if portions > 1:
            part = checkpointed(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found.distinct()
