"""Soft-membership mixing of sources to target weights, in DataFrame operations only.

Domains are the classes of the labelled table (quality and toxic). Features of a text are its hashed words, word
bigrams and word shapes (letters left out). For each of the two labels the features that tell most (chi square, at
most ``LEXICON``) make a naive Bayes score; the two scores' bins make a text's cell, and the shares of the labelled
documents of a cell, smoothed by those of all, are the domain posteriors. Documents of a cell have equal posteriors
and rates; there are at most 100 cells whatever the input.

Rates minimise the scaled squares of (expected domain token totals - targets) plus a small pull towards 1, rates
being nonnegative: they are the projection max(0, 1 - p . x / pull), where x, one number a domain, follows the
gradient, scaled by its curvature, until the condition of optimality holds. Each gradient is one distributed
aggregate. A target that is missed by over 2 % is warned of.

``copies`` of a document are floor(rate + u) with u in [0, 1) from a hash of its id, so that expected totals are
those of the rates. Defined results: null and empty texts have one token, so that totals are positive; a null id
hashes as a value of its own; repeated rows are rated each on its own, and teach once; labels with a null id, quality
or toxic teach nothing; repeated labels of an id count once (the lowest of each); without labels posteriors are
uniform; a domain of which no document has any posterior can't be met, and the least squares leave it; an empty
table stays empty; columns of any name are kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

# Domains (quality, toxic) and their shares of the tokens.
TARGETS = {"q0t0": 0.08, "q0t1": 0.02, "q1t0": 0.82, "q1t1": 0.08}
#: Labelled documents that features are chosen from, features a label, and documents that must hold one.
LEXICON_DOCS, LEXICON, LEAST_DOCS, PULL = 3000, 64, 5, 1e-4
#: Bounds of a score's bins (log odds), and the weight of all documents' shares in a cell's.
EDGES, SMOOTH = (-6, -4, -2, -1, 0, 1, 2, 4, 6), 2.0
LABELS = ("quality", "toxic")
CELL = ("quality_bin", "toxic_bin")


class Lexicon(NamedTuple):
    """For each label the score of a text without features, and what each hashed feature adds."""

    base: dict[str, float]
    weights: dict[str, dict[int, float]]


def split_words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+")


def grams(words: Column, text: Column) -> Column:
    """Hashed words, bigrams (one value for a word said twice) and shapes of words."""
    shapes = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{L}+", "a"), r"[ \t\n\r]+")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(a == b, F.lit(1).cast("long")).otherwise(F.coalesce(F.xxhash64(a, b), F.lit(0))))
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), pairs, F.transform(shapes, lambda w: F.xxhash64(w, F.lit(0))))


def _sum_of(held: str, weights: Column) -> Column:
    return F.aggregate(held, F.lit(0.0), lambda a, h: a + F.coalesce(F.try_element_at(weights, h), F.lit(0.0)))


def featured(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with the cell columns and n_tokens."""
    words = split_words(F.col(text_col))
    known = sorted(set().union(*lexicon.weights.values()))
    out = docs.withColumn("__words", words)
    ends = (F.element_at("__words", 1) == "").cast("int") + (F.element_at("__words", -1) == "").cast("int")
    out = out.withColumn("n_tokens", F.greatest(F.size("__words") - ends, F.lit(1)).cast("long"))
    held = F.array_intersect(grams(F.col("__words"), F.col(text_col)), F.array(*map(F.lit, known)).cast("array<bigint>")) if known else F.array().cast("array<bigint>")
    out = out.withColumn("__held", held)
    for label, cell in zip(LABELS, CELL, strict=True):
        w = lexicon.weights[label]
        total = F.lit(float(lexicon.base[label]))
        if w:
            total = total + _sum_of("__held", F.create_map(*(F.lit(x) for k, v in sorted(w.items()) for x in (k, float(v)))))
        found = F.lit(len(EDGES))
        for k, x in reversed(list(enumerate(EDGES))):
            found = F.when(F.col(f"__{cell}") <= x, k).otherwise(found)
        out = out.withColumn(f"__{cell}", total).withColumn(cell, found.cast("int"))
    return out.drop("__words", "__held", *(f"__{c}" for c in CELL))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): one row for each labelled id."""
    known = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    return known.groupBy("doc_id").agg(F.format_string("q%dt%d", F.min("quality"), F.min("toxic")).alias("domain"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, most_docs: int = LEXICON_DOCS, size: int = LEXICON) -> Lexicon:
    """The most telling features of each label, from at most ``most_docs`` labelled documents."""
    known = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(*(F.min(x).alias(x) for x in LABELS))
    drawn = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    held = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", *LABELS).agg(F.min("text").alias("text"))
    held = cut(held.select(*LABELS, F.array_distinct(grams(split_words(F.col("text")), F.col("text"))).alias("grams")))
    n, *ones = held.agg(F.count("*"), *(F.coalesce(F.sum(x), F.lit(0)) for x in LABELS)).first()
    counts = held.select(*LABELS, F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("m"), *(F.sum(x).alias(x) for x in LABELS)).where(F.col("m") >= LEAST_DOCS)
    out = Lexicon({}, {})
    if n:
        counts = cut(counts)
    for label, n1 in zip(LABELS, ones, strict=True):
        n0, out.base[label], out.weights[label] = n - n1, 0.0, {}
        if not n0 or not n1:
            continue
        m, m1 = F.col("m").cast("double"), F.col(label).cast("double")
        chi = F.pow(m1 - m * n1 / n, F.lit(2.0)) / (m * n1 / n * n0 / n * (1 - m / n) + 1e-9)
        a, b = (m1 + 0.5) / (n1 + 1), (m - m1 + 0.5) / (n0 + 1)
        best = counts.withColumn("chi", chi).where("chi > 25").select("gram", "chi", F.log(a / b).alias("held"), F.log((1 - a) / (1 - b)).alias("lacked"))
        rows = best.orderBy(F.desc("chi"), "gram").limit(size).collect()
        out.base[label] = float(np.log(n1 / n0) + sum(r["lacked"] for r in rows))
        out.weights[label] = {r["gram"]: r["held"] - r["lacked"] for r in rows}
    return out


def posteriors(cells: DataFrame, known: DataFrame, domains: list[str]) -> DataFrame:
    """``cells`` with an array of posteriors, ordered as ``domains``. known: (cell columns, domain), one row for each labelled document."""
    counts = known.where(F.col("domain").isin(domains)).groupBy(*CELL).pivot("domain", domains).agg(F.count("domain"))
    counts = cut(counts.select(*CELL, *(F.coalesce(d, F.lit(0)).alias(d) for d in domains)))
    totals = counts.agg(*(F.coalesce(F.sum(d), F.lit(0)) for d in domains)).first()
    prior = [float((x + 1) / (sum(totals) + len(domains))) for x in totals]
    n = sum((F.coalesce(d, F.lit(0)) for d in domains), F.lit(0.0))
    p = F.array(*((F.coalesce(d, F.lit(0)) + SMOOTH * x) / (n + SMOOTH) for d, x in zip(domains, prior, strict=True)))
    return cells.join(F.broadcast(counts), list(CELL), "left").withColumn("p", p).drop(*domains)  # a row a cell: at most 100


def solve_rates(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float]], t: np.ndarray, pull: float = PULL, tolerance: float = 1e-9, most_steps: int = 500) -> np.ndarray:
    """x, at the optimum the residual (share - target) / target of each domain.

    ``sums`` gives for x the domains' shares under the rates max(0, 1 - p . x / pull), the matrix of the posteriors'
    products over the rows with a positive rate, and the sum of the squared rates, all weighted by tokens. x moves
    along the dual's gradient, scaled by its curvature and halved until the dual grows. Raises if that doesn't end.
    """
    def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        share, products, square = sums(x)
        return share - t - t * x, products, -pull / 2 * square - t @ x - t @ x**2 / 2

    x = np.zeros(len(t))
    gap, products, dual = at(x)
    for _ in range(most_steps):
        if np.abs(gap / t).max() < tolerance:
            return x
        move = np.linalg.solve(products / pull + np.diag(t), gap)
        size, slope = 1.0, gap @ move
        new = at(x + move)
        while new[2] < dual + 1e-4 * size * slope and size > 1e-12:
            size /= 2
            new = at(x + size * move)
        x = x + size * move
        gap, products, dual = new
    raise RuntimeError(f"mixing rates did not converge: gaps {(gap / t).tolist()}")


def rate_of(p: Column, x: Sequence[float], pull: float = PULL) -> Column:
    return F.greatest(F.lit(0.0), sum((p[k] * F.lit(-float(v) / pull) for k, v in enumerate(x)), F.lit(1.0)))


def fit_rates(cells: DataFrame, targets: dict[str, float], pull: float = PULL) -> DataFrame:
    """``cells`` (tokens, p) with ``rate``. Targets that can't be met are warned of."""
    t = np.array(list(targets.values()))
    t = t / t.sum()
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("rate", F.lit(1.0))
    d = range(len(t))
    weighed = cells.coalesce(1).select("p", (F.col("tokens") / F.lit(float(total))).alias("w"))

    def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        on = weighed.withColumn("r", rate_of(F.col("p"), x, pull))
        p = F.col("p")
        products = [F.sum(F.when(F.col("r") > 0, F.col("w") * p[i] * p[j]).otherwise(0.0)) for i in d for j in d]
        row = list(on.agg(*(F.sum(F.col("w") * F.col("r") * p[k]) for k in d), *products, F.sum(F.col("w") * F.col("r") * F.col("r"))).first())
        return np.array(row[: len(t)]), np.array(row[len(t) : -1]).reshape(len(t), len(t)), row[-1]

    x = solve_rates(sums, t, pull)
    missed = {k: round(float(1 + v), 4) for k, v in zip(targets, x, strict=True) if abs(v) > 0.02}
    if missed:
        warnings.warn(f"mixing targets not met, reached shares of them: {missed}", stacklevel=2)
    return cells.withColumn("rate", rate_of(F.col("p"), x, pull))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells with posteriors and rates, and every document's cell and tokens (doc_id, n_tokens, cell; all of the row as
    ``__row`` where it is asked for). Texts are read for the lexicon and once more."""
    row = [F.struct(*docs.columns).alias("__row")] if whole else []  # a struct, so that no column's name clashes
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row)
    seen = cut(featured(own, learn_lexicon(own, labels)).drop("text"))
    cells = cut(seen.groupBy(*CELL).agg(F.sum("n_tokens").alias("tokens")))
    known = seen.where("doc_id is not null").select("doc_id", *CELL).distinct().join(domains_of(labels), "doc_id")
    return cut(fit_rates(cut(posteriors(cells, known, list(targets))), targets)), seen


def rated(placed: DataFrame, cells: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that have their cell columns, with p, rate and copies. The cells are a table of a bounded size."""
    u = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = placed.join(F.broadcast(cells.select(*CELL, "p", F.col("rate").alias("__rate"))), list(CELL))
    return out.withColumn("rate", F.col("__rate")).drop("__rate").withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` as often as their rates say: left out, once or repeated."""
    cells, seen = mixed(docs, labels, targets, whole=True)
    kept = rated(seen, cells).where("copies > 0")
    return kept.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("__row.*")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cells, seen = mixed(docs, table(spark, sf_dir, "labels"))
    domains = list(TARGETS)
    return rated(seen, cells).select("doc_id", "n_tokens", *(F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(domains)), F.round("rate", 9).alias("rate"), "copies")
