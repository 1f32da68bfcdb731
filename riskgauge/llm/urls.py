"""URL filters: rules where one fits, else gradient-boosted trees on lexical features.

Features: length, host and path length, host labels, path depth, digit ratio, byte entropy, parameters, hyphens,
and suffix statistics: the smoothed block rates of the host's last label, its last two, and the path's file ending.
The trees are trained with logistic loss on at most ``train_rows`` distinct labelled urls, which the rules label;
every url is judged.

Defined results: a null url, or one without "://", has empty host and path and no rule; a null rule verdict goes
to the trees; where no labelled url exists, the trees allow; repeated rows are judged each on its own, and teach once;
rows with a null id are judged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged as R
from .common import ship, table

# Verdict and rule.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRAIN_ROWS, ROUNDS, DEPTH, BINS, RATE = 20_000, 40, 3, 32, 0.2


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits. The list is part of the query, so it must be short."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}"), F.lit(rule)).otherwise(out)
    return out


def features(url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
    """(rows, 11) lexical features."""
    data, off = R.raw(url)
    data, off = data[off[0] : off[-1]], off - off[0]
    n, size = len(off) - 1, np.diff(off).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(off))
    def count(*bytes_: int) -> np.ndarray:
        return np.bincount(row[np.isin(data, bytes_)], minlength=n).astype(np.float64)
    entropy = np.zeros(n)
    for i in range(0, n, 4096):
        j = min(n, i + 4096)
        h = np.bincount((row[off[i] : off[j]] - i) * 256 + data[off[i] : off[j]], minlength=(j - i) * 256).reshape(-1, 256)
        p = h / np.maximum(1, size[i:j, None])
        entropy[i:j] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    length = lambda a: np.diff(R.raw(a)[1]).astype(np.float64)
    hosts, paths = host.to_pylist(), path.to_pylist()
    return np.column_stack([
        size, length(host), length(path), [h.count(".") + 1 for h in hosts], [p.count("/") for p in paths], count(*range(48, 58)) / np.maximum(1, size),
        entropy, count(ord("="), ord("&")), count(ord("-")), [h.endswith(".html") for h in paths], count(ord("#")),
    ]).astype(np.float64)


def suffixes(hosts: list[str], paths: list[str]) -> list[list[str]]:
    """The host's last label, its last two, and the ending of the path's last part (at most 8 characters, else none)."""
    ends = [p.rpartition("/")[2].rpartition(".") for p in paths]
    return [[h.rpartition(".")[2] for h in hosts], [".".join(h.split(".")[-2:]) for h in hosts], [e if dot and len(e) <= 8 else "" for _, dot, e in ends]]


class Trees:
    """Trees of equal depth: at each level one threshold for each node, and a value for each leaf."""

    def __init__(self, base: float, rates: list[dict[str, float]], trees: list) -> None:
        self.base, self.rates, self.trees = base, rates, trees

    def matrix(self, url: pa.Array, host: pa.Array, path: pa.Array) -> np.ndarray:
        prior = 1 / (1 + np.exp(-self.base))
        rate = [[r.get(x, prior) for x in names] for r, names in zip(self.rates, suffixes(host.to_pylist(), path.to_pylist()), strict=True)]
        return np.column_stack([features(url, host, path), *rate])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[np.arange(len(x)), feature[at]] > limit[at])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def fit(url: pa.Array, host: pa.Array, path: pa.Array, y: np.ndarray) -> Trees:
    """Boosted trees by histograms of gradients, second-order leaf values."""
    if not len(y):
        return Trees(-1.0, [{}] * 3, [])
    prior, rates = y.mean(), []
    for names in suffixes(host.to_pylist(), path.to_pylist()):
        known, at = np.unique(np.array(names), return_inverse=True)
        n, blocked = np.bincount(at), np.bincount(at, y)
        rates.append({str(k): float((b + 10 * prior) / (m + 10)) for k, b, m in zip(known, blocked, n, strict=True)})
    model = Trees(float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), rates, [])
    x = model.matrix(url, host, path)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p) + 1e-9
        node, n_inner = np.zeros(len(y), dtype=np.int64), (1 << DEPTH) - 1
        feature, limit = np.zeros(n_inner, dtype=np.int64), np.full(n_inner, np.inf)
        for level in range(DEPTH):
            for k in range(1 << level):
                rows = np.flatnonzero(node == k)
                best = 1e-9
                for f, e in enumerate(edges):
                    if not len(e) or not len(rows):
                        continue
                    gs, hs = (np.cumsum(np.bincount(binned[rows, f], w[rows], len(e) + 1)) for w in (g, h))
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    if gain.max() > best:
                        best, feature[(1 << level) - 1 + k], limit[(1 << level) - 1 + k] = gain.max(), f, e[int(gain.argmax())]
            at = (1 << level) - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > limit[at])
        value = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        total += value[node]
        model.trees.append((feature, limit, value))
    return model


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row; score is the trees' block probability."""
    u = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("page_id"), u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    drawn = own.where("rule is not null").select("url", "host", "path", "rule").distinct().orderBy(F.xxhash64("url"), "url").limit(train_rows).toArrow().combine_chunks()
    verdict = {r: v for v, r in rules}
    y = np.array([verdict[r] == "block" for r in drawn.column("rule").to_pylist()], dtype=np.float64)
    cols = [drawn.column(c).combine_chunks() if len(y) else pa.array([], pa.string()) for c in ("url", "host", "path")]
    model = fit(*cols, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(model.matrix(b.column("url"), b.column("host"), b.column("path"))) if b.num_rows else np.zeros(0)
            verdicts = [verdict[r] if r is not None else "block" if s >= 0.5 else "allow" for r, s in zip(b.column("rule").to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    ship(pages.sparkSession)
    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
