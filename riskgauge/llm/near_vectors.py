"""Embedding near-dedup with a pivot index and exact bounds.

Reference points (pivots) are rows of the table. A vector is in the list of its nearest pivot, in the near or far
part of it, and a list keeps the least and the greatest angle of its members to the pivot. With angles as a metric,
and as no other pivot is nearer to a member than its own, two lists hold no link if their pivots, or the members of
one and the pivot of the other, stand too far apart. All other lists are compared in full, by cosines in double
precision, so every link is found whatever the pivots are: they only say what need not be compared. Dense groups
meet only lists that touch them; rows with no structure at all are compared with each other, which takes time with
the square of their number.

Small lists are pooled and large ones are cut into blocks. Pairs of blocks give link counts and a spanning forest,
never pairs; equal vectors are one entry with a multiplicity.

The number of pivots grows with the square root of the rows (a bounded table: ``most_pivots``). The pivots are the
only thing fitted on a bounded sample (``sample``); every row is indexed.

Defined results: vectors that are null, zero, or hold a null or non-finite component link with nothing, as do
vectors of different lengths; repeated vec_ids are separate rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R
from .common import components, cut, join_hot, release, table

THRESHOLD, BLOCK, TILE = 0.95, 4096, 512
#: The angle of the threshold; members of a list are near up to twice this angle.
ANGLE = math.acos(THRESHOLD)
#: Far above the rounding errors of an angle and of a cosine.
ANGLE_SLACK, COSINE_SLACK = 1e-6, 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, safe from overflow and underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def home(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot (its number) and the angle to it."""
    near = x @ pivots.T
    at = near.argmax(axis=1)
    return at.astype(np.int32), np.arccos(np.clip(near[np.arange(len(x)), at], -1, 1))


def fit_pivots(vectors: DataFrame, sample: int = 4096, most_pivots: int = 1024, seed: int = 5) -> dict[int, np.ndarray]:
    """Pivots for each vector length of the sample. ``vectors``: (v array<double>)."""
    total = vectors.count()
    drawn = vectors.select("v").orderBy(F.xxhash64("v")).limit(sample).toPandas()["v"]
    by: dict[int, list] = {}
    for v in drawn:
        by.setdefault(len(v), []).append(v)
    out = {}
    for d, rows in by.items():
        x = unit(np.array(rows, dtype=np.float64))
        n = min(len(x), most_pivots, max(32, round(2 * math.sqrt(total))))
        out[d] = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    return out


def pivots_for(fitted: dict[int, np.ndarray], d: int) -> np.ndarray:
    """The fitted pivots, or random directions for a length that the sample hasn't."""
    return fitted[d] if d in fitted else unit(np.random.default_rng(d).standard_normal((64, d)))


def _post(fitted: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("v").value_lengths())
            for d in np.unique(size):
                rows = pa.array(np.flatnonzero(size == d))
                v = b.column("v").take(rows)
                pivot, angle = home(unit(matrix(v)), pivots_for(fitted, int(d)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(v), d), pa.int32()), pa.array(pivot), pa.array((angle > 2 * ANGLE).astype(np.int32)), pa.array(angle),
                    b.column("rep").take(rows), b.column("copies").take(rows), v,
                ], names=["dim", "pivot", "far", "angle", "rep", "copies", "v"])
    return run


def may_link(pivots: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which lists (pivot's number, least and greatest angle) can hold a link between them."""
    between = np.arccos(np.clip(pivots[at] @ pivots[at].T, -1, 1))
    r = ANGLE + ANGLE_SLACK
    # a member of one list is at least its own least angle from the other list's pivot
    return (between <= most[:, None] + most + r) & (least <= most[:, None] + r) & (least[:, None] <= most + r)


def pools(fitted: dict[int, np.ndarray], lists: list) -> tuple[list[tuple], list[tuple]]:
    """Lists' pools (dim, pivot, far, pool, blocks), and pools that meet (pool, other, blocks of the other)."""
    placed, meet, first = [], [], 0
    for d in sorted({x["dim"] for x in lists}):
        own = sorted((x for x in lists if x["dim"] == d), key=lambda x: (x["far"], x["pivot"]))
        of, rows = [], []
        for k, x in enumerate(own):  # a pool takes lists of one part until it has a block
            if not rows or rows[-1] + x["n"] > BLOCK or x["far"] != own[k - 1]["far"]:
                rows.append(0)
            rows[-1] += x["n"]
            of.append(len(rows) - 1)
        blocks = [-(-n // BLOCK) for n in rows]
        may = may_link(pivots_for(fitted, d), *(np.array([x[k] for x in own]) for k in ("pivot", "least", "most")))
        starts = np.searchsorted(of, np.arange(len(rows)))
        may = np.logical_or.reduceat(np.logical_or.reduceat(may, starts, axis=0), starts, axis=1)
        placed += [(d, x["pivot"], x["far"], first + o, blocks[o]) for x, o in zip(own, of, strict=True)]
        meet += [(first + int(a), first + int(b), blocks[b]) for a, b in zip(*np.nonzero(may), strict=True)]
        first += len(rows)
    return placed, meet


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: (id, links found here, least row of its tree here)."""
    for t in R.row_groups(batches, ["lo_pool", "lo", "hi_pool", "hi"]):
        t = t.combine_chunks()
        ids, copies, low = (t.column(k).to_numpy() for k in ("rep", "copies", "low"))
        across = (t.column("lo_pool")[0], t.column("lo")[0]) != (t.column("hi_pool")[0], t.column("hi")[0])
        x, many = unit(matrix(t.column("v").chunk(0))), copies.astype(np.float64)
        left = np.flatnonzero(low)
        right = np.flatnonzero(~low) if across else left
        count, root = np.zeros(len(ids)), np.arange(len(ids))
        other = x[right].T
        for s in range(0, len(left), TILE):
            rows = left[s : s + TILE]
            near = x[rows] @ other
            ok = near >= THRESHOLD
            i, j = np.nonzero(np.abs(near - THRESHOLD) < COSINE_SLACK)  # decided alike in both orders
            ok[i, j] = np.einsum("ij,ij->i", x[rows[i]], x[right[j]]) >= THRESHOLD
            if not across:
                ok[np.arange(len(rows)), np.arange(s, s + len(rows))] = False
            on = np.flatnonzero(ok.any(axis=1))
            if not len(on):
                continue
            rows, ok = rows[on], ok[on]
            count[rows] += ok @ many[right]
            if across:
                count[right] += many[rows] @ ok
            for k, i in enumerate(rows):  # least row number of each tree
                own = root[right[ok[k]]]
                least = min(root[i], own.min())
                if root[i] != least or (own != least).any():
                    root[np.isin(root, np.append(own, root[i]))] = least
        on = np.flatnonzero(count)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(ids[on], pa.int64()), pa.array(count[on].astype(np.int64)), pa.array(ids[root[on]], pa.int64())], names=["id", "links", "to"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 4096, most_pivots: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    good = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    own = cut(own.withColumn("v", F.when(good & F.col("vec_id").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0)))))
    classes = cut(own.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    fitted = fit_pivots(classes, sample, most_pivots)
    posted = cut(classes.select("rep", "copies", "v").mapInArrow(
        _post(fitted), "dim int, pivot int, far int, angle double, rep long, copies long, v array<double>"))
    lists = posted.groupBy("dim", "pivot", "far").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()  # at most 2 * most_pivots rows a length
    placed, meet = pools(fitted, lists)
    spark = vectors.sparkSession
    spread = posted.join(spark.createDataFrame(placed, "dim int, pivot int, far int, pool int, blocks int"), ["dim", "pivot", "far"]).select(
        "pool", F.pmod(F.xxhash64("rep", "pool"), F.col("blocks").cast("long")).cast("int").alias("block"), "rep", "copies", "v")
    met = spread.join(spark.createDataFrame(meet, "pool int, other_pool int, others int"), "pool").withColumn("other", F.explode(F.expr("sequence(0, others - 1)")))
    low = (F.col("pool") < F.col("other_pool")) | ((F.col("pool") == F.col("other_pool")) & (F.col("block") <= F.col("other")))
    pair = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    both = met.select(pair("pool", "other_pool").alias("lo_pool"), pair("block", "other").alias("lo"), pair("other_pool", "pool").alias("hi_pool"), pair("other", "block").alias("hi"), low.alias("low"), "rep", "copies", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lo_pool", "lo", "hi_pool", "hi"]
    found = cut(both.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare, "id long, links long, to long"))
    release(posted)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    of_class = cut(classes.select("v", "rep", "copies").join(links, F.col("rep") == links["id"], "left").drop("id").join(tied, F.col("rep") == tied["id"], "left").select(
        "v", "copies", F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    release(classes, found, tied)
    out = join_hot(own, of_class, "v", "copies", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
