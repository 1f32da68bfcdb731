"""Vectorised word work on Arrow string columns: whole batches of texts as one byte array.

A word is a maximal run of bytes of a given class; classes are ASCII-decided, so byte work equals
code point work on UTF-8. Texts are never joined: a text's end always ends its last word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240917)
SYMBOL = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, off


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, off: np.ndarray, of_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``buf``, and for each text the range of its words (n + 1 bounds). ``off`` starts at 0."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_word = of_word[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        p, q = np.full(size, BASE, dtype=np.uint64), np.full(size, BASE_INV, dtype=np.uint64)
        p[0] = q[0] = 1
        _powers[:] = [np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word (A-Z as a-z), whatever its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(SYMBOL[LOWER[buf]] * p[: len(buf)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts])


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (its whole sequence if shorter) and their n + 1 bounds; repeats remain."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_bounds[-1], dtype=np.uint64)
    factors = SYMBOL[:k] * U(0xD6E8FEB86659FD93) + U(2)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * (factors[i] | U(1))
        s = mix(s)
    for_long = np.flatnonzero(n >= k)
    if len(for_long):
        # positions of the shingles of long texts: each text's first word and on
        c = counts[for_long]
        first = np.repeat(bounds[for_long] - np.concatenate(([0], np.cumsum(c)[:-1])), c)
        to = np.repeat(out_bounds[for_long] - np.concatenate(([0], np.cumsum(c)[:-1])), c)
        at = np.arange(c.sum())
        out[at + to] = s[at + first]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = h[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix(np.array([(own * (factors[: len(own)] | U(1))).sum(dtype=np.uint64) + U(len(own))], dtype=np.uint64))[0]
    return out, out_bounds


def row_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by them; a run may cross batches. Runs must be of bounded size."""
    held: list[pa.Table] = []

    def bounds(t: pa.Table) -> list[int]:
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return [0, *np.flatnonzero(change), t.num_rows]

    for b in batches:
        t = pa.Table.from_batches([b])
        if held:
            t, held = pa.concat_tables([*held, t]), []
        if not t.num_rows:
            continue
        cuts = bounds(t)
        for i, j in zip(cuts[:-2], cuts[1:-1], strict=False):
            yield t.slice(i, j - i)
        held = [t.slice(cuts[-2])]
    if held and (t := pa.concat_tables(held)).num_rows:
        yield t
