"""MinHash near-dedup of documents by min-max hashing.

Every permutation's hash of every word 5-shingle is evaluated once and gives two signature values, the least and
the greatest, so 75 evaluations make 150 values. Bands of 5 values bring candidates together; full shingle sets
confirm links. Only components are returned, so pairs are never listed: documents with equal sets are one class.

A bucket (the classes with a band in common) is first compared with its hub, the member with the largest buckets,
which for a group of copies of one text is that text. What remains are pairs of one bucket in different
components: all of them are compared, in blocks of bounded size that hold texts of similar length (others can't
link), and a block pair gives a spanning forest of its links. Buckets that share classes are compared as one group.
Every pair that shares a band and isn't tied through others is thus decided on full sets. A pair at similarity 0.85 shares no band
with probability 2e-8, one at 0.8 with 7e-6.

Defined results: a null or wordless text has an empty set and links with nothing; a null doc_id is kept with
a null component; repeated rows of one doc_id share its component; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R
from .common import components, cut, join_hot, release, table, trimmed

U = np.uint64
PERMUTATIONS, BANDS, ROWS = 75, 30, 5
#: Classes of a block and shingles of a block, whichever is less; pairs of a hub that meet in one task's row group.
BLOCK, BLOCK_SHINGLES, SPREAD = 1024, 400_000, 256
_rng = np.random.default_rng(77)
FACTOR = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
SHIFT = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-max signatures, (texts, 2 * PERMUTATIONS); rows of empty texts are 0."""
    out = np.zeros((len(bounds) - 1, 2 * PERMUTATIONS), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at = bounds[full]
        for i in range(PERMUTATIONS):
            x = s * FACTOR[i]
            x += SHIFT[i]
            out[full, 2 * i] = np.minimum.reduceat(x, at)
            out[full, 2 * i + 1] = np.maximum.reduceat(x, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), U(b + 1))
        for r in range(ROWS):
            h = R.mix(h + sig[:, (b + BANDS * r) % sig.shape[1]] * U(0x9FB21C651E98DF25))
        keys[:, b] = h
    return keys.view(np.int64)


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, bounds) by chunks of rows."""
    data, off = R.raw(text)
    for i, j in R.chunks(off):
        buf, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, bounds = R.words(buf, o)
        yield i, j, *R.shingles(R.word_hashes(buf, starts, ends), bounds)


def distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, s, bounds in shingle_sets(batch.column(1)):
            sets = [distinct(s[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            keys = band_keys(signatures(s, bounds)).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([hashlib.md5(x.tobytes()).digest() for x in sets], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys)),
            ], names=["doc_id", "n_shingles", "class", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, s, bounds in shingle_sets(batch.column("text")):
            sets = [distinct(s[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["rep", "s"])


def shared(row: np.ndarray, value: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of the sets of rows ``left`` and ``right``; (row, value) are the members of n sets."""
    _, at, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    on = often[at]
    row, at = row[on], number[at[on]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, int(often.sum()), 2048):
        i, j = np.searchsorted(at, [c, c + 2048])
        x = np.zeros((n, 2048), dtype=np.float32)
        x[row[i:j], at[i:j] - c] = 1
        out += x[left] @ x[right].T
    return out


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of each block pair's links between components."""
        for t in R.row_groups(batches, ["band", "lo", "hi"]):
            comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
            s = t.column("s").combine_chunks()
            size = np.diff(s.offsets.to_numpy())
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(left) or not len(right):
                continue
            both = shared(np.repeat(np.arange(len(comp)), size), s.flatten().to_numpy(), left, right, len(comp)).astype(np.int64)
            ok = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (comp[left][:, None] != comp[right])
            names, root = np.unique(comp, return_inverse=True)
            names, root, left, right = names.tolist(), root.tolist(), left.tolist(), right.tolist()
            tree = list(range(len(names)))

            def find(i: int, tree: list[int] = tree) -> int:
                while tree[i] != i:
                    tree[i] = tree[tree[i]]
                    i = tree[i]
                return i

            a, b = [], []
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                p, q = find(root[left[i]]), find(root[right[j]])
                if p != q:
                    tree[max(p, q)] = min(p, q)
                    a.append(names[p])
                    b.append(names[q])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; links are at ``percent`` % similarity or more."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(own.mapInArrow(trimmed(_fingerprints), "doc_id long, n_shingles long, class binary, bands array<long>"))
    usable = prints.where("n_shingles > 0 and doc_id is not null")
    classes = cut(usable.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")))
    found = class_components(own, classes, percent)
    of_class = classes.select("class", "rep", "copies").join(found, "rep", "left").select("class", "copies", F.coalesce("component", "rep").alias("component"))
    joined = prints.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    out = join_hot(joined, of_class, "class", "copies", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def class_components(own: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(rep, component) of the classes' least ids that are linked."""
    posted = classes.select("rep", "n", F.explode("bands").alias("band"))
    sizes = posted.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("size", F.col("rows"))
    held = cut(join_hot(posted, sizes, "band", "rows"))
    central = held.groupBy("rep").agg(F.sum("size").alias("central"))
    sets = cut(own.join(central.select("rep"), own["doc_id"] == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text").mapInArrow(
        trimmed(_sets), "rep long, s array<long>"))
    hubs = cut(held.join(central, "rep").groupBy("band").agg(
        F.max_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), F.struct("central", -F.col("rep"))).alias("h"), F.count("*").alias("rows")).select("band", "rows", "h.*"))
    pairs = join_hot(held.select("rep", "n", "band"), hubs, "band", "rows").where("rep <> hub")
    tied = components(confirmed(pairs.select("rep", "n", "hub", "hub_n").distinct(), sets, percent)).withColumnRenamed("id", "rep")
    release(hubs)
    posted = held
    held = posted.select("rep", "n", "band").join(tied, "rep", "left").select("rep", "n", "band", F.coalesce("component", "rep").alias("comp"))
    links = rest_links(held, sets, percent)
    release(posted, sets)
    again = components(links).withColumnRenamed("id", "old")  # links between components
    release(links)
    many = tied.groupBy("component").agg(F.count("*").alias("rows")).withColumnRenamed("component", "old")
    moved = many.join(again, "old").select("old", "rows", F.col("component").alias("to"))
    of_tied = join_hot(tied.withColumnRenamed("component", "old"), moved, "old", "rows", "left").select("rep", F.coalesce("to", "old").alias("component"))
    return of_tied.union(again.join(tied, again["old"] == tied["rep"], "left_anti").select("old", "component"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): those pairs (rep, n, hub, hub_n) whose full sets link. A hub's pairs are spread over tasks."""
    many = pairs.groupBy("hub").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / SPREAD).cast("int"))
    spread = join_hot(pairs, many, "hub", "rows").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int")).drop("parts")
    hub_sets = many.join(sets.select(F.col("rep").alias("hub"), F.col("s").alias("hub_s")), "hub").select("hub", "hub_s", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    both = F.size(F.array_intersect("s", "hub_s"))
    found = spread.join(sets, "rep").join(hub_sets, ["hub", "part"]).select("rep", "hub", both.alias("both"), F.size("s").alias("x"), F.size("hub_s").alias("y"))
    return found.where(f"both > 0 and 100L * both >= {percent}L * (x + y - both)").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def rest_links(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components of classes (rep, n, band, comp) in one bucket that are linked.

    Buckets of one component are done with. The others that share classes make a group, so that a pair is compared
    once and not for every band. A block holds classes of one group and of similar set size, and of one component
    where that has a block's worth of members. Blocks of one component aren't compared with each other, nor are
    sizes that can't link.
    """
    mixed = cut(held.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("rows"), F.min("rep").alias("low")).where("c0 <> c1").select("band", "rows", "low"))
    step = math.log(100 / percent) if percent < 100 else 1e-9
    shared_by = cut(join_hot(held, mixed, "band", "rows"))
    release(mixed)
    grouped = components(shared_by.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    groups = grouped.select(F.col("id").alias("rep"), F.col("component").alias("band"))
    held = cut(shared_by.select("rep", "n", "comp").distinct().join(groups, "rep").withColumn("level", F.floor(F.log("n") / step + 1e-9)))
    release(shared_by, grouped)
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.floor(BLOCK_SHINGLES / F.max("n"))))
    counts = held.groupBy("band", "level", "comp").agg(F.count("*").alias("rows"), most.alias("most"))
    counts = counts.withColumn("alone", F.when(F.col("rows") >= F.col("most"), F.col("comp")))  # null: pooled with others
    units = counts.groupBy("band", "level", "alone").agg(F.ceil(F.sum("rows") / F.min("most")).cast("int").alias("parts"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"u.{k}")) for k in ("band", "level", "alone")]
    of_comp = counts.alias("c").join(units.alias("u"), same).select(F.struct("c.band", "c.level", "c.comp").alias("key"), "c.rows", "c.alone", "u.parts")
    keyed = held.select("rep", "band", "level", "comp", F.struct("band", "level", "comp").alias("key"))
    block = F.xxhash64("level", F.col("alone").isNull(), F.coalesce("alone", F.lit(0)), "part")
    members = join_hot(keyed, of_comp, "key", "rows").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int"))
    members = cut(members.select("rep", "band", "comp", block.alias("block")))
    blocks = units.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("band", "level", "alone", block.alias("block"))
    other = blocks.select("band", F.col("level").alias("level2"), F.col("alone").alias("alone2"), F.col("block").alias("block2"))
    meet = blocks.join(other, "band").where("(level2 = level + 1 or (level2 = level and block <= block2)) and not coalesce(alone = alone2, false)")
    meet = cut(meet.select("band", F.col("block").alias("lo"), F.col("block2").alias("hi")))
    on_lo = members.withColumnRenamed("block", "lo").join(meet, ["band", "lo"]).withColumn("side", F.when(F.col("lo") == F.col("hi"), 2).otherwise(0))
    on_hi = members.withColumnRenamed("block", "hi").join(meet.where("lo <> hi"), ["band", "hi"]).withColumn("side", F.lit(1))
    placed = on_lo.unionByName(on_hi).join(sets, "rep").select("band", "lo", "hi", "side", "comp", "s")
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["band", "lo", "hi"]
    links = cut(placed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(trimmed(_links(percent)), "a long, b long"))
    release(held, members, meet)
    return links


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
