"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte spans. Each adjacent pair whose joined bytes have a rank stands in that
rank's bucket by its left position; three levels of bitmaps tell which buckets hold something, so the lowest
rank is found by three find-first-set steps. Merging a pair leaves old entries behind; an entry counts only if
its position still starts a live pair of that rank. Buckets give their leftmost entry first. A pre-token of n
bytes takes O(n log n) steps, so one of a million bytes is no trouble.

Short pre-tokens share a queue: the distinct ones of many texts lie in one list, parted by marks that pair with
nothing, and a bucket's entries are merged together, the leftmost of each pre-token. A pre-token's own merges keep
their order (its lowest rank, then its leftmost pair), so ids are those of a queue of its own.

Defined results: a null text is an empty text, which has no tokens; a text is encoded whole; rows with a null id
and repeated rows are encoded each on its own; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_cache, ship

#: Pre-tokens longer than this are not kept in the cache. A text that finds this many entries in it starts a new
#: generation, which falls back on the one before; no generation takes more than twice as many.
CACHE_CHARS, GENERATION = 40, 300_000
#: Bytes of a pre-token that has a queue of its own, pre-tokens that share none, and bytes of pre-tokens and characters
#: of texts handled at once.
LONG, FEW, POOL, TEXTS = 64, 256, 1 << 21, 1 << 22


def parse_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def as_text(ids: Iterable[int]) -> str:
    return " ".join(map(str, ids))


class Cache(dict):
    """Pre-token to its ids, as text; what isn't here comes from the older generation or is encoded."""

    def __init__(self, encode, old: dict[str, str]) -> None:
        self.encode, self.old = encode, old

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)  # get() doesn't encode there
        if ids is None:
            ids = as_text(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHE_CHARS and len(self) < 2 * GENERATION:
            self[piece] = ids
        return ids


class Bpe:
    """Ranks, a pre-token pattern, and the rank queue: three levels of bitmaps over the ranks, a bucket for each rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.bytes_of = {str(v): k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        n = self.mark = max(self.ranks.values()) + 1
        self.low, self.mid = [0] * ((n >> 6) + 1), [0] * ((n >> 12) + 1)
        self.cache = Cache(self.encode_piece, {})
        self.byte_rank = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        get, pairs = self.ranks.get, {}
        for whole, r in self.ranks.items():  # every way to join two tokens to one
            for i in range(1, len(whole)):
                a, b = get(whole[:i]), get(whole[i:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = r
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_rank = np.array([pairs[k] for k in keys.tolist()] + [-1], dtype=np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where they don't join."""
        key = a * (self.mark + 1) + b
        at = self.pair_keys.searchsorted(key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], -1)

    def encode_pool(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many short pre-tokens by one queue."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate(([0], np.cumsum(size + 1))) + 1  # a mark before each piece and after the last
        total = int(start[-1])
        token = np.full(total, self.mark, dtype=np.int64)
        inside = np.ones(total, dtype=bool)
        inside[start - 1] = False
        token[inside] = self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        owner = np.cumsum(~inside)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        pair = np.full(total, -1, dtype=np.int64)
        pair[:-1] = self.rank_of(token[:-1], token[1:])
        low, mid, top = self.low, self.mid, 0
        buckets: dict[int, list[np.ndarray]] = {}
        fresh = np.flatnonzero(pair >= 0)
        ranks = pair[fresh]
        while True:
            if len(ranks):  # into the queue
                order = ranks.argsort(kind="stable")
                ranks, fresh = ranks[order], fresh[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                ends = [*cuts.tolist(), len(ranks)]
                i = 0
                for r, j in zip(ranks[np.concatenate(([0], cuts))].tolist(), ends, strict=True):
                    bucket = buckets.get(r)
                    if bucket is None:
                        buckets[r] = [fresh[i:j]]
                        low[r >> 6] |= 1 << (r & 63)
                        mid[r >> 12] |= 1 << (r >> 6 & 63)
                        top |= 1 << (r >> 12)
                    else:
                        bucket.append(fresh[i:j])
                    i = j
            if not top:
                break
            b = (top & -top).bit_length() - 1  # find first set, level by level
            m = mid[b]
            a = (b << 6) + (m & -m).bit_length() - 1
            w = low[a]
            r = (a << 6) + (w & -w).bit_length() - 1
            bucket = buckets.pop(r)
            w &= w - 1
            low[a] = w
            if not w:
                m &= m - 1
                mid[b] = m
                if not m:
                    top &= top - 1
            i = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            i = i[pair[i] == r]  # the others are stale
            if len(i) > 1:
                i.sort()
                own = owner[i]
                first = np.ones(len(i), dtype=bool)
                first[1:] = own[1:] != own[:-1]
                late, i = i[~first], i[first]  # a pre-token's later pairs wait for what its first merge brings
            else:
                late = i[:0]
            if not len(i):
                ranks = late
                continue
            j = after[i]
            k = after[j]
            pair[j] = -1
            token[i] = r
            after[i] = k
            before[k] = i
            h = before[i]
            right, left = self.rank_of(token[i], token[k]), self.rank_of(token[h], token[i])
            pair[i], pair[h] = right, left
            fresh = np.concatenate((i[right >= 0], h[left >= 0], late))
            ranks = np.concatenate((right[right >= 0], left[left >= 0], np.full(len(late), r)))
        live = np.zeros(total + 1, dtype=bool)
        at = start[:-1]
        at = at[size > 0]
        while len(at):  # follow the lists in step
            live[at] = True
            at = after[at]
            at = at[token[at] != self.mark]
        ids, upto = token[live[:total]].tolist(), np.concatenate(([0], np.cumsum(live)))[start - 1].tolist()
        return [ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue's bitmaps and buckets are empty before and after."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, low, mid, top = len(piece), self.low, self.mid, 0
        after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)  # pair: rank of the live pair that starts here
        buckets: dict[int, list[int]] = {}
        fresh = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        for r, i in fresh:
            pair[i] = r
        while True:
            for r, i in fresh:  # into the queue
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [i]
                    low[r >> 6] |= 1 << (r & 63)
                    mid[r >> 12] |= 1 << (r >> 6 & 63)
                    top |= 1 << (r >> 12)
                else:
                    heappush(bucket, i)
            if not top:
                break
            fresh = []
            b = (top & -top).bit_length() - 1  # find first set, level by level
            m = mid[b]
            a = (b << 6) + (m & -m).bit_length() - 1
            w = low[a]
            r = (a << 6) + (w & -w).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                w &= w - 1
                low[a] = w
                if not w:
                    m &= m - 1
                    mid[b] = m
                    if not m:
                        top &= top - 1
            if pair[i] != r:
                continue  # stale: merged away, or its pair has changed
            j = after[i]
            pair[j] = -1
            after[i] = k = after[j]
            pair[i] = -1
            if k < n:
                before[k] = i
                s = get(piece[i : after[k]])
                if s is not None:
                    pair[i] = s
                    fresh.append((s, i))
            h = before[i]
            if h >= 0:
                s = get(piece[h:k])
                if s is None:
                    pair[h] = -1
                elif pair[h] != s:
                    pair[h] = s
                    fresh.append((s, h))
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Put what the cache lacks of these short pre-tokens there."""
        cache, old = self.cache, self.cache.old
        pool: list[tuple[str, bytes]] = []
        size = 0

        def encode() -> None:
            found = self.encode_pool([b for _, b in pool]) if len(pool) > FEW else [self.encode_piece(b) for _, b in pool]
            for (p, _), ids in zip(pool, found, strict=True):
                cache[p] = as_text(ids)
            pool.clear()

        for p in pieces:
            if p in cache:
                continue
            if (ids := old.get(p)) is not None:
                cache[p] = ids
                continue
            b = p.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(b)) is not None:
                cache[p] = str(r)
            elif len(b) <= LONG:
                pool.append((p, b))
                size += len(b)
                if size > POOL:
                    encode()
                    size = 0
        if pool:
            encode()

    def encode_texts(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids joined by one space, of each text."""
        i = 0
        while i < len(texts):
            j, n, found = i, 0, []
            while j < len(texts) and n < TEXTS:
                found.append(self.find(texts[j]))
                n += len(texts[j])
                j += 1
            if len(self.cache) >= GENERATION:
                self.cache.old = {}
                self.cache = Cache(self.encode_piece, self.cache)
            self.learn({p for f in found for p in f if len(p) <= CACHE_CHARS})
            get = self.cache.__getitem__
            for f in found:
                yield " ".join(map(get, f))
            i = j

    def encode_as_text(self, text: str) -> str:
        return next(self.encode_texts([text]))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_as_text(text).split()))

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_text(as_text(ids))

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


_loaded: dict[tuple[str, str], Bpe] = {}


def on_workers(spark: SparkSession, path: str, pattern: str) -> Callable[[], Bpe]:
    """A function that gives a worker its vocabulary, one per process, so that its cache lives on from task to task.

    The driver reads the file; workers get its bytes by broadcast (it is a vocabulary, whose size doesn't grow).
    """
    ship(spark)
    with open(path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def get() -> Bpe:
        one_cache(_loaded)
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = Bpe(parse_ranks(file.value), pattern)
        return _loaded[path, pattern]

    return get


def parts(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for s in range(0, batch.num_rows, rows):
        yield batch.slice(s, rows)


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>) of every text."""
    get = on_workers(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches:
            for part in parts(batch):
                ids = [list(map(int, x.split())) for x in bpe.encode_texts([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of every row of ids."""
    get = on_workers(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x or ()) for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and return digests of both: nothing as large as the ids leaves the worker."""
    get = on_workers(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        sha = hashlib.sha256
        for batch in batches:
            rows: list[tuple] = []
            for part in parts(batch):
                for ids in bpe.encode_texts([t or "" for t in part.column(1).to_pylist()]):
                    rows.append((ids.count(" ") + 1 if ids else 0, sha(ids.encode()).hexdigest(), sha(bpe.decode_text(ids)).hexdigest()))
            n, ids_sha, decoded_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
