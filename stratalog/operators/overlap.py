"""Shared shingles of all pairs of texts in a place, counted in Arrow batches with only that place's texts in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that leave in one batch.
OUT = 50_000


def searcher(k: int, jaccard: float, containment: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows (grp, x, y, at, cls, s[, notes, members]) sorted by place (grp, x, y): the pairs of each place, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, table in places(batches):
            yield from pairs(place, table, k, jaccard, containment)

    return run


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    now, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "x", "y"))))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            if end > begin:
                if keys[begin] != now and held:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = keys[begin]
                held.append(batch.slice(begin, end - begin))
    if held:
        yield now, pa.Table.from_batches(held)


def dense(codes: np.ndarray) -> np.ndarray:
    return pa.array(codes).dictionary_encode().indices.to_numpy().astype(np.int64)


def shingles(column: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of each row's distinct shingles, by row and id. Equal ids are equal words: no hash is taken here."""
    column = column.combine_chunks()
    lists = pc.split_pattern(column, " ") if k else column
    lens = pc.list_value_length(lists).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    flat = pc.list_flatten(lists)
    if k:
        words = flat.dictionary_encode()
        codes, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
        first = np.flatnonzero(np.arange(len(row)) + k - 1 < np.cumsum(lens)[row])
        row, code, most = row[first], codes[first], n
        for i in range(1, k):
            if most * n >= 2**62:
                code = dense(code)
                most = int(code.max(initial=0)) + 1
            code, most = code * n + codes[first + i], most * n
    else:
        code = flat.to_numpy()
    if not len(row):
        return row, row
    ids = dense(code)
    width = int(ids.max()) + 1
    both = np.unique(row * width + ids)
    return both // width, both % width


def pairs(place: tuple, table: pa.Table, k: int, jaccard: float, containment: float) -> Iterator[pa.RecordBatch]:
    grp, x, y = place
    key_type = table.schema.field("cls").type
    row, ids = shingles(table["s"], k)
    keys = table["cls"].to_pylist()
    size = np.bincount(row, minlength=len(keys))
    ends = np.cumsum(size)
    same: dict[bytes, list[int]] = {}
    for r, (begin, end) in enumerate(zip((ends - size).tolist(), ends.tolist())):
        same.setdefault(ids[begin:end].tobytes(), []).append(r)
    # Classes, those of the first block before those of the second.
    at = table["at"].to_numpy()
    groups = sorted(same.values(), key=lambda rows: at[rows[0]])
    first = np.array([rows[0] for rows in groups])
    cut = int((at[first] == x).sum()) if x < y else 0
    number = np.full(len(keys), -1)
    number[first] = np.arange(len(groups))
    key, size = np.array([min(keys[r] for r in rows) for rows in groups]), size[first]
    row = number[row]
    keep = (row >= 0) & (np.bincount(ids)[ids] > 1)
    row, ids = row[keep], ids[keep]
    order = np.lexsort((ids, row))
    row, ids = row[order], ids[order]
    # Postings: the rows of each shingle, of the second block alone where there are two.
    inner = np.flatnonzero(row >= cut)
    inner = inner[np.argsort(ids[inner], kind="stable")]
    posting = row[inner]
    stop = np.cumsum(np.bincount(ids[inner], minlength=int(ids.max(initial=0)) + 1))
    hi = stop[ids]
    if x < y:
        lo = hi - np.diff(stop, prepend=0)[ids]
    else:
        lo = np.empty(len(row), dtype=np.int64)
        lo[inner] = np.arange(1, len(inner) + 1)
    skip = linked(table, groups, cut, x < y) if "members" in table.column_names else {}
    bounds = np.searchsorted(row, np.arange(len(groups) + 1)).tolist()
    lo, hi = lo.tolist(), hi.tolist()
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        i = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        j, jac, con = (np.concatenate([h[c] for h in held]) for c in (1, 2, 3))
        a, b = key[i], key[j]
        arrays = [pa.repeat(pa.scalar(grp, pa.string()), len(j)), pa.array(np.minimum(a, b) if a.dtype != object else [min(p) for p in zip(a, b)], key_type), pa.array(np.maximum(a, b) if a.dtype != object else [max(p) for p in zip(a, b)], key_type), pa.array(jac), pa.array(con)]
        return pa.RecordBatch.from_arrays(arrays, names=["grp", "a", "b", "jaccard", "containment"])

    for i in range(cut if x < y else len(groups)):
        slices = [posting[p:q] for p, q in zip(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]]) if q > p]
        if not slices:
            continue
        met = np.concatenate(slices)
        if len(met) * 8 < len(groups):
            j, shared = np.unique(met, return_counts=True)
        else:
            counts = np.bincount(met)
            j = np.flatnonzero(counts)
            shared = counts[j]
        jac, con = shared / (size[i] + size[j] - shared), shared / np.minimum(size[i], size[j])
        good = (jac >= jaccard) | (con >= containment)
        if i in skip:
            good &= ~np.isin(j, skip[i])
        if good.any():
            held.append((i, j[good], jac[good], con[good]))
            n += len(held[-1][1])
            if n >= OUT:
                yield batch()
                held, n = [], 0
    if held:
        yield batch()


def linked(table: pa.Table, groups: list[list[int]], cut: int, two: bool) -> dict[int, np.ndarray]:
    """Of each class, the later ones with which it is linked: each two of their notes, one way at least. A class has `notes` notes, of which `members` have a slug or links."""
    members, notes = table["members"].to_pylist(), table["notes"].to_pylist()
    owner, slugs, targets = [], [], []
    for c, rows in enumerate(groups):
        for r in rows:
            for m in members[r]:
                owner.append(c)
                slugs.append(m["slug"])
                targets.append(m["links"] or ())
    of = np.array([sum(notes[r] for r in rows) for rows in groups], dtype=np.int64)
    named: dict[str, list[int]] = {}
    for m, slug in enumerate(slugs):
        if slug is not None:
            named.setdefault(slug, []).append(m)
    named_at = {slug: np.array(ms) for slug, ms in named.items()}
    found = [(m, hit) for m, links in enumerate(targets) for t in set(links) if (hit := named_at.get(t)) is not None]
    if not found:
        return {}
    p, q = np.repeat([m for m, _ in found], [len(hit) for _, hit in found]), np.concatenate([hit for _, hit in found])
    own, n = np.array(owner), len(owner)
    both = np.unique(np.minimum(p, q) * n + np.maximum(p, q))
    p, q = own[both // n], own[both % n]
    apart = (p < cut) & (q >= cut) if two else p < q
    both, times = np.unique(p[apart] * len(groups) + q[apart], return_counts=True)
    p, q = both // len(groups), both % len(groups)
    whole = times == of[p] * of[q]
    p, q = p[whole], q[whole]
    begins = np.searchsorted(p, np.arange(len(groups) + 1))
    return {int(i): q[begins[i] : begins[i + 1]] for i in np.unique(p)}
