"""Prefix filter for near duplicates in Arrow batches: shingles are hashed where the texts are, only the rarest of each text leave.

Any order over shingles that is the same everywhere finds all pairs; how often a shingle occurs is therefore kept for 2 ** BITS buckets of hashes, which is of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Buckets of hashes that are counted, rows that a task's counts leave in, bytes taken at once, of which a row counts as ROW at least, pairs that leave in one batch.
BITS, PARTS, BYTES, ROW, OUT = 22, 64, 4_000_000, 128, 50_000
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Whether a byte of lower-case text is part of a word; odd factors of a shingle's words.
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8))
FACTORS = [int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(16)]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def portions(batch: pa.RecordBatch, column: str = "s") -> Iterator[pa.RecordBatch]:
    """Slices of about BYTES bytes of the column."""
    part = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64) + ROW) // BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each k successive words of lower-case texts, repeats and all."""
    offsets, data = flat(column)
    letter = LETTER[data]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    start[begins] = letter[begins]
    lens = np.diff(np.searchsorted(np.flatnonzero(start), offsets))
    ends = np.r_[np.flatnonzero(start[letter]), letter.sum()].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data[letter])).dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words.dictionary.to_pylist()], dtype=np.uint64)
    each = each[words.indices.to_numpy()]
    row = np.repeat(np.arange(len(lens)), lens)
    n = max(0, len(each) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h += each[i : i + n] * np.uint64(FACTORS[i])
    whole = row[:n] == row[len(row) - n :]
    return row[:n][whole], mixed(h[whole])


def ordered(row: np.ndarray, h: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """The order by row (below 2 ** 16), `often` and hash: by one number that holds most of it, unless that leaves a tie of different hashes."""
    by = row.astype(np.uint64) << np.uint64(48) | h >> np.uint64(24)
    if often is not None:
        by |= often.astype(np.uint64) << np.uint64(40)
    at = np.argsort(by)
    by, sorted_h = by[at], h[at]
    if ((by[1:] == by[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
        return np.lexsort((h, row) if often is None else (h, often, row))
    return at


def distinct(row: np.ndarray, h: np.ndarray, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    at = ordered(row, h, often)
    row, h = row[at], h[at]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each, to a tenth; 0 is none."""
    return np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8)


def meant(codes: np.ndarray) -> np.ndarray:
    return (2 ** (np.arange(256) / 8) - 1).astype(np.float32)[codes]


def counter(k: int) -> Run:
    """Rows (s) to (part, codes): a task's number of shingles in each bucket. With k of 0, s is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, dtype=np.int64)
        held, size, seen = [], 0, False
        for rows in (p for batch in batches for p in (portions(batch) if k else [batch])):
            held.append(bucket(hashes(rows["s"], k)[1] if k else mixed(rows["s"].to_numpy().view(np.uint64))))
            size, seen = size + len(held[-1]), True
            if size > 1 << BITS:
                counts += np.bincount(np.concatenate(held), minlength=1 << BITS)
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << BITS)
        if seen:
            yield parts(dict(enumerate(np.split(coded(counts), PARTS))))

    return run


def parts(codes: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.int32()), pa.array([c.tobytes() for c in codes.values()], pa.binary())], names=["part", "codes"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, codes), those of a part in one task, to one row a part."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, codes in zip(batch["part"].to_pylist(), batch["codes"]):
            sums[part] = sums.get(part, 0) + meant(np.frombuffer(codes.as_buffer(), dtype=np.uint8))
    if sums:
        yield parts({p: coded(c) for p, c in sums.items()})


def signer(k: int, least: float, order) -> Run:
    """Rows (key, s) to (key, d1, d2, n, prefix): a set's digests and size, and the hashes of its n - ceil(least * n) + 1 rarest shingles. Texts too short for one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(order.value, dtype=np.uint8)
        for rows in (p for batch in batches for p in portions(batch)):
            row, h = hashes(rows["s"], k)
            row, h = distinct(row, h, often[bucket(h)])
            n = np.bincount(row, minlength=rows.num_rows)
            rows, n = rows.filter(pa.array(n > 0)), n[n > 0]
            if not len(n):
                continue
            row, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            d1, d2 = np.add.reduceat(mixed(h), begin), np.bitwise_xor.reduceat(mixed(~h), begin)
            keep = (n - np.ceil(least * n - 1e-9) + 1).astype(np.int64)
            kept = h[np.arange(len(h)) - begin[row] < keep[row]]
            ends = np.r_[0, np.cumsum(keep) * 8].astype(np.int32)
            prefix = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
            yield pa.RecordBatch.from_arrays([rows["key"], pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n.astype(np.int32)), prefix], names=["key", "d1", "d2", "n", "prefix"])

    return run


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, n, prefix) to (h, cls, n, at), a row for each hash and its place in the set's order."""
    for batch in batches:
        for rows in portions(batch, "prefix"):
            lens = pc.binary_length(rows["prefix"]).to_numpy() // 8
            h = np.frombuffer(b"".join(rows["prefix"].to_pylist()), dtype=np.int64)
            row = np.repeat(np.arange(len(lens)), lens)
            at = np.arange(len(h)) - (np.cumsum(lens) - lens)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h), rows["cls"].take(pa.array(row)), rows["n"].take(pa.array(row)), pa.array(at.astype(np.int32))], names=["h", "cls", "n", "at"])


def meeting(least: float) -> Run:
    """Rows (h, cls, n, at), sorted by h, to pairs (a, b) that meet in an h and can still be alike.

    An h that is the first which two sets share leaves as many to share as come after it in either; a pair that is too far on there met before, or never is alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch["h"].to_numpy()
            cut = int(np.searchsorted(h == h[-1], True)) if len(h) else 0
            if cut or (held and len(h) and held[-1]["h"][0].as_py() != h[-1]):  # the last h may go on
                yield from met(pa.Table.from_batches([*held, batch.slice(0, cut)]), least)
                held = []
            held += [batch.slice(cut)] if len(h) else []
        if held:
            yield from met(pa.Table.from_batches(held), least)

    return run


def met(table: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    h, n, at = (table[c].to_numpy() for c in ("h", "n", "at"))
    same = h[1:] == h[:-1]
    twice = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    twice = twice[np.lexsort((n[twice], h[twice]))]
    h, n, at, keys = h[twice], n[twice].astype(np.int64), at[twice].astype(np.int64), table["cls"].combine_chunks().take(pa.array(twice))
    i, found, size, step = np.arange(len(h)), [], 0, 0

    def batch() -> pa.RecordBatch:
        a, b = (pa.array(np.concatenate(x)) for x in zip(*found))
        return pa.RecordBatch.from_arrays([keys.take(a), keys.take(b)], names=["a", "b"])

    while len(i):
        step += 1
        i = i[i + step < len(h)]
        j = i + step
        i = i[(h[i] == h[j]) & (n[i] >= least * n[j] - 1e-9)]  # sizes rise: no later one is in reach
        j = i + step
        good = np.minimum(n[i] - at[i], n[j] - at[j]) >= least / (1 + least) * (n[i] + n[j]) - 1e-9
        if good.any():
            found.append((i[good], j[good]))
            size += len(found[-1][0])
            if size >= OUT:
                yield batch()
                found, size = [], 0
    if found:
        yield batch()


def wanted(marks) -> Run:
    """Rows (key, s, id) to those (key, s) of which the id's bucket is marked; what is no word in s is blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(marks.value, dtype=np.uint8)
        for batch in batches:
            rows = batch.filter(pa.array(marked[bucket(mixed(batch["id"].to_numpy().view(np.uint64)))] > 0))
            for part in portions(rows):
                offsets, data = flat(part["s"])
                blank = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.where(LETTER[data], data, np.uint8(32))))
                yield pa.RecordBatch.from_arrays([part["key"], blank.cast(pa.string())], names=["key", "s"])

    return run


def judge(k: int) -> Run:
    """Rows (a, b, sa, sb) to (a, b, shared, na, nb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (q for batch in batches for p in portions(batch, "sa") for q in portions(p, "sb")):
            m = rows.num_rows
            row, h = distinct(*hashes(pa.concat_arrays([rows["sa"], rows["sb"]]), k))
            n, pair = np.bincount(row, minlength=2 * m), row % m
            at = ordered(pair, h)
            pair, h = pair[at], h[at]
            shared = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])], minlength=m)
            arrays = [rows["a"], rows["b"], *(pa.array(x.astype(np.int64)) for x in (shared, n[:m], n[m:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "shared", "na", "nb"])

    return run
