"""Quality classifier by Bradley-Terry pairwise ranking.

A text is a vector of byte, word and line statistics, each also in quantile bins. Preference pairs of a labelled
good and a labelled bad text teach weights by logistic loss on the difference of their features. A quantile of
the training scores (the one that parts the labels best) becomes the threshold; a text's score is the logistic
of its distance to it, shifted so that 0.3 stands at the threshold.

Fitted on at most ``train_docs`` labelled rows; everything else covers all rows. Defined results: null and empty
texts are scored as texts without words; rows with a null id are scored too; a labelled id that occurs more than
once counts with its lowest label; without both labels every score is 1 (nothing is known against a text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R
from .common import give_back, one_cache, remainder, ship, table, trimmed

TRAIN_DOCS, PAIRS, STEPS, CUT = 6000, 30_000, 400, 0.3
_groups = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": b".", "comma": b",;:", "bang": b"!?",
    "mark": b"*$%&#@^~", "bar": b"|/\\_<>{}[]", "high": range(128, 256), "other": b"\"'()-+=",
}
GROUP = np.full(256, len(_groups), dtype=np.uint8)
for _k, _v in enumerate(_groups.values()):
    GROUP[list(_v)] = _k
NOT_LINE = np.ones(256, dtype=bool)
NOT_LINE[[10, 13]] = False
N_BASE = len(_groups) + 11


def _ratio_distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and of values equal to the one before, by text."""
    n = np.diff(bounds)
    if not len(h):
        return np.zeros(len(n)), np.zeros(len(n))
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    s, r = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    m = np.maximum(1, n)
    return np.bincount(r[new], minlength=len(n)) / m, np.bincount(row[again], minlength=len(n)) / m


def features(text: pa.Array) -> np.ndarray:
    """(texts, N_BASE) statistics."""
    data, off = R.raw(text)
    out = np.zeros((len(off) - 1, N_BASE))
    k = len(_groups)
    for i, j in R.chunks(off):
        buf, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        n, size = j - i, np.maximum(1, np.diff(o))
        row = np.repeat(np.arange(n), np.diff(o))
        counts = np.bincount(row * (k + 1) + GROUP[buf], minlength=n * (k + 1)).reshape(n, k + 1)[:, :k]
        starts, ends, bounds = R.words(buf, o)
        m = np.maximum(1, np.diff(bounds))
        length = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), ends - starts, n) / m
        distinct, again = _ratio_distinct(R.word_hashes(buf, starts, ends), bounds)
        ls, le, lb = R.words(buf, o, NOT_LINE)
        line_distinct, line_again = _ratio_distinct(R.word_hashes(buf, ls, le), lb)
        letters = np.maximum(1, counts[:, 0] + counts[:, 1])
        out[i:j] = np.column_stack([
            np.sqrt(counts / size[:, None]), np.log1p(np.diff(o)), np.log1p(np.diff(bounds)), np.log1p(length), distinct, again, line_distinct, line_again,
            counts[:, 0] / letters, np.log1p(np.diff(lb)), counts[:, 5] / m, (counts[:, 7] + counts[:, 8] + counts[:, 9]) / m,
        ])
    return out


class Ranker:
    """Weights of standardised and binned features, and the score of the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, bins: int = 6) -> None:
        self.known = len(set(y.tolist())) == 2
        if not self.known:
            return
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        z, rng = self.expand(x), np.random.default_rng(seed)
        good, bad = rng.choice(np.flatnonzero(y == 1), PAIRS), rng.choice(np.flatnonzero(y == 0), PAIRS)
        d = z[good].astype(np.float32)
        d -= z[bad]
        w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
        for t in range(1, STEPS + 1):  # Adam on the logistic loss of differences
            g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(axis=0) + 1e-3 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w
        s = z @ w
        quantiles = np.quantile(s, np.linspace(0.0025, 0.9975, 399))
        right = [((s >= q) == (y == 1)).mean() for q in quantiles]
        best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
        self.threshold = float(quantiles[best[len(best) // 2]])

    def expand(self, x: np.ndarray) -> np.ndarray:
        parts = [np.clip((x - self.mean) / self.sd, -6, 6)]
        for c, e in zip(x.T, self.edges, strict=True):
            parts.append((np.searchsorted(e, c, "right")[:, None] == np.arange(len(e) + 1)).astype(np.float64))
        return np.hstack(parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.ones(len(x))
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.w - self.threshold + np.log(CUT / (1 - CUT)), -30, 30)))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_BASE, dtype=np.int32), pa.array(x.ravel()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, held_out: int | None = 0) -> Ranker:
    """Fits on labelled rows; those with crc32(doc_id) mod 5 equal to ``held_out`` are left out (None: no row is)."""
    seen = labels.where("doc_id is not null and quality in (0, 1)")
    if held_out is not None:
        seen = seen.where(remainder("doc_id", 5) != held_out)
    ship(docs.sparkSession)
    seen = seen.groupBy("doc_id").agg(F.min("quality").alias("label")).join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id").select("label", "text").mapInArrow(_features_of, "label int, x array<double>").toArrow()
    if not rows.num_rows:
        return Ranker(np.zeros((0, N_BASE)), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_BASE)
    order = np.lexsort((*x.T[:4], rows.column("label").to_numpy()))  # the same model whatever the order of partitions
    return Ranker(x[order], rows.column("label").to_numpy()[order])


def scores(docs: DataFrame, model: Ranker, keep: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``keep`` (none of them may be named score) and score."""
    own = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_cache({})
        for b in batches:
            s = model.score(features(b.column("__text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])

    ship(docs.sparkSession)
    give_back()  # what training took
    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(trimmed(run), f"{kinds}, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scores(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return s.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
