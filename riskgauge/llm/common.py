"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


#: Bytes of one Arrow batch on its way to Python, where the session sets no limit: long texts make small batches.
ARROW_BYTES = "16m"
#: Keys whose rows are joined by a broadcast table, and the rows that a key must have for that.
HOT_KEYS, HOT_ROWS = 1024, 100
#: Edges of a partition between rounds of ``components``, and its least number of partitions.
PART_EDGES, LEAST_PARTS = 50_000, 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A local session may do without; a cluster may not."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not find it otherwise, and bound Arrow batches by bytes."""
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":  # unset
        spark.conf.set(limit, ARROW_BYTES)
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    path = os.path.join(tempfile.mkdtemp(prefix="code"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_caches: list[dict] = []


def one_cache(own: dict) -> None:
    """A worker process lives through many stages: it keeps the cache of one operator, the one that runs."""
    for c in _caches:
        if c is not own:
            c.clear()
    _caches[:] = [own]


def give_back() -> None:
    """Give memory that this process doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def trimmed(run):
    """``run`` of Arrow batches; at its end the worker, which lives on, gives memory that it doesn't use back to the system."""
    def through(batches):
        yield from run(batches)
        give_back()
    return through


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that lost executors cost one stage at most.

    The driver's garbage is collected then, by which Spark removes the shuffles of plans that are done with from the
    executors' disks: with many partitions each leaves three small files for every task.
    """
    checkpoint_dir(df.sparkSession)
    ship(df.sparkSession)
    out = df.checkpoint(True)
    del df
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut``. Call it when all that was made of them has been cut itself."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        file = t._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col: str, n: int):
    """crc32 of the column as text, mod n (null where the column is null)."""
    return F.crc32(F.col(col).cast("string")) % F.lit(n)


def join_hot(many: DataFrame, one: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``many`` joined by ``key`` to ``one``, a table of one row for each non-null key, whatever the skew of ``many``.

    ``rows`` is the column of ``one`` with the key's number of rows in ``many`` (it is dropped). The HOT_KEYS keys with
    the most rows are broadcast, so of the keys that are shuffled none has more than 1 / HOT_KEYS of all rows.
    Rows with a null key match nothing and aren't shuffled. how: inner or left. ``one`` is evaluated twice.
    """
    hot = one.where(F.col(rows) >= HOT_ROWS).orderBy(F.desc(rows), key).limit(HOT_KEYS).collect()
    one = one.drop(rows)
    order = [*many.columns, *(c for c in one.columns if c != key)]
    known = many.where(F.col(key).isNotNull())
    if hot:
        names = [c for c in one.columns if c != key]
        with_hot = many.sparkSession.createDataFrame([(*(r[c] for c in one.columns), True) for r in hot], StructType([*one.schema, StructField("__hot", BooleanType())]))
        tried = known.join(F.broadcast(with_hot), key, "left")
        rest = tried.where("__hot is null").drop("__hot", *names).join(one, key, how)
        out = tried.where("__hot").select(*order).union(rest.select(*order))
    else:
        out = known.join(one, key, how).select(*order)
    if how == "left":
        out = out.unionByName(many.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 1000) -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star.

    Returns (id, component), cut, for every node that has an edge; component is the smallest id reachable.
    A node's neighbours are only ever aggregated with ``min`` (combined before the shuffle) and joined, hubs by
    broadcast, so no node's neighbourhood is collected. Each round is checkpointed, in partitions by the number of
    edges: few edges make few tasks, however many partitions shuffles have. Rounds grow with the logarithm of the
    longest path.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state()
    for _ in range(most_rounds):
        parts = max(LEAST_PARTS, seen[0] // PART_EDGES)
        few = e.coalesce(parts)
        both = few.union(few.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        # large star: every larger neighbour is tied to the least of the neighbourhood
        large = cut(join_hot(both.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts))
        # small star: u and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, cut(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        release(old, large)
        if (now := state()) == seen:
            found = cut(e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
            release(e)
            return found
        seen = now
    raise RuntimeError("components did not converge")
