"""Encoding of whole texts with a public byte-level BPE vocabulary.

Method: texts of a batch are laid end to end as one array of codepoints. A table gives each codepoint's
class, shifted copies give the lookahead, and both together the symbol of a small automaton. Each symbol
is a function from states to states; composing these functions is associative, so the automaton runs
as a parallel prefix over the array, without a regex or a loop over characters. It marks where pieces
begin; each distinct piece is merged once and kept. Piece offsets stay available for decoding.

The split is that of the vocabulary's published pattern:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Symbols: letter, digit, other, blank that joins what follows, last blank of a run, other blank, apostrophes of one- and two-letter contractions, text border.
L, N, O, JOIN, LAST, BLANK, CON1, CON2, EDGE = range(9)
#: States: at a beginning; in letters, digits, others; after a joining blank; in blanks; one or two letters of a contraction to come.
BEGIN, IN_L, IN_N, IN_O, JOINED, IN_BLANK, ONE, TWO = range(8)
CHUNK = 1 << 20  # codepoints handled at once, more only for a single text beyond that
CACHE = 400_000  # pieces kept by a worker before it starts anew
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state] -> state; begins[symbol, state]: whether a piece begins at that symbol."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    into = {L: IN_L, N: IN_N, O: IN_O, JOIN: JOINED, LAST: BEGIN, BLANK: IN_BLANK, CON1: ONE, CON2: TWO, EDGE: BEGIN}
    for symbol, state in into.items():
        step[symbol] = state
        if symbol != EDGE:
            step[symbol, ONE], step[symbol, TWO] = BEGIN, ONE
            begins[symbol, [ONE, TWO]] = False
    for symbol, state in ((L, IN_L), (N, IN_N), (O, IN_O), (BLANK, IN_BLANK)):
        begins[symbol, state] = False
        if symbol != BLANK:
            begins[symbol, JOINED] = False
    for symbol in (CON1, CON2):  # inside other signs, or joined to a blank, an apostrophe is one of them
        step[symbol, [IN_O, JOINED]] = IN_O
        begins[symbol, [IN_O, JOINED]] = False
    return step, begins


STEP, BEGINS = _automaton()


@functools.cache
def classes() -> np.ndarray:
    """Class of every codepoint: L, N, O or BLANK."""
    table = np.full(sys.maxunicode + 1, O, np.uint8)
    category = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    table[category == "L"], table[category == "N"] = L, N
    table[WHITE] = BLANK
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of functions (n, states), earlier ones applied first.

    Doubling, ended once every composed function is constant: what lies before can't matter then.
    """
    reach = 1
    while reach < len(functions) and (functions != functions[:, :1]).any():
        later, earlier = functions[reach:], functions[:-reach]
        functions = np.concatenate([functions[:reach], np.take_along_axis(later, earlier, axis=1)])
        reach *= 2
    return functions


def boundaries(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """True where a piece begins. codes: codepoints; edges: True at the separators between texts."""
    kind = classes()[codes]
    kind[edges] = EDGE
    follows = np.append(kind[1:], EDGE)
    symbol = kind.copy()
    last = (kind == BLANK) & (follows != BLANK) & (follows != EDGE)
    symbol[last] = np.where(codes[last] == 32, JOIN, LAST)
    quote = np.flatnonzero((codes == 39) & ~edges)
    padded = np.append(codes, [0, 0])
    one, two = padded[quote + 1], padded[quote + 2]
    symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = CON1
    pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    symbol[quote[pair]] = CON2
    functions = STEP[symbol]
    functions[0] = functions[0, BEGIN]  # nothing lies before the first
    state = scan(functions)[:, BEGIN]
    before = np.concatenate([[BEGIN], state[:-1]])
    return BEGINS[symbol, before] & ~edges


class Merger:
    """Byte-pair merging by rank, with every piece's result kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        got = self.known.get(text)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            data = text.encode()
            got = [self.ranks[data]] if data in self.ranks else self._merge(data)
            if len(text) < 200:
                self.known[text] = got
        return got

    def _merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals; a heap over linked parts, so long pieces stay near linear."""
        ranks, n = self.ranks, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not alive[a] or b >= n or not alive[b] or after[a] != b or end[b] != stop or end[a] != b:
                continue
            alive[b], end[a], after[a] = False, stop, after[b]
            if after[a] < n:
                before[after[a]] = a
                if (r := ranks.get(data[a : end[after[a]]])) is not None:
                    heapq.heappush(heap, (r, a, after[a], end[after[a]]))
            if before[a] >= 0 and (r := ranks.get(data[before[a] : stop])) is not None:
                heapq.heappush(heap, (r, before[a], a, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, codepoint offset of each piece) of every text; null and empty ones give empty arrays."""
        out, at = [], 0
        while at < len(texts):
            size, stop = 0, at
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") < CHUNK):
                size += len(texts[stop] or "") + 1
                stop += 1
            out += self._chunk([t or "" for t in texts[at:stop]])
            at = stop
        return out

    def _chunk(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        joined = "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        edges = np.zeros(len(codes), bool)
        edges[ends] = True
        starts = np.flatnonzero(boundaries(codes, edges))
        # A piece ends where the next begins, or at its text's border.
        border = ends[np.searchsorted(ends, starts)] if len(starts) else starts
        stops = np.minimum(np.append(starts[1:], len(codes)), border)
        known, piece = self.known, self.piece
        ids = [known.get(p := joined[a:b]) or piece(p) for a, b in zip(starts.tolist(), stops.tolist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for p in ids for i in p), np.int32, int(sizes.sum()))
        first = np.searchsorted(starts, ends - [len(t) for t in texts])
        last = np.searchsorted(starts, ends)
        total = np.concatenate([[0], sizes.cumsum()])
        return [(flat[total[a] : total[b]], starts[a:b] - (e - len(t))) for a, b, e, t in zip(first, last, ends, texts)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


_MERGERS: dict[int, Merger] = {}


def merger(lines: bytes) -> Merger:
    """One per Python worker and vocabulary, so pieces stay known between batches and tasks."""
    key = hash(lines)
    if key not in _MERGERS:
        _MERGERS[key] = Merger(read_ranks(lines))
    return _MERGERS[key]


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(key, ids[, offsets]) of each row; null and empty texts give an empty list, blank ones are encoded like others.

    vocabulary: path of the rank file, read on the driver and broadcast (under 2 MB for 50,000 entries; checked).
    Rows with repeated or null keys each keep their row. No shuffle: a narrow pass over the two columns.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(shared.value)
        for batch in batches:
            done = own.encode(batch.column(1).to_pylist())
            lists = [int_lists([d[i] for d in done]) for i in range(1 + offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "ids", "offsets"][: 2 + offsets])

    schema = f"{key} {dict(df.dtypes)[key]}, ids array<int>" + ", offsets array<int>" * offsets
    return df.select(key, text).mapInArrow(run, schema)


def int_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list<int32> array of numpy parts, without a Python object per value."""
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32))


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids)."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in merger(shared.value).ranks.items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, "ids").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, text string")
