"""From raw documents to token ids: quality, language, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; every stage but the
last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgauge.llm import byte_bpe, language, mixing, near_text, quality
from riskgauge.llm.common import checkpoint_dir, cut, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language posteriors below this mean that no language fits a text.
LEAST_LANGUAGE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay. All labels teach: no row is held out here.

    Null and empty texts and rows with a null id are judged like all others; repeated rows are judged alike; without
    both labels every document stays.
    """
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), held_out=None)
    return quality.scores(docs, model, COLUMNS).where(F.col("score") >= quality.CUT).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, and ``lang`` becomes the predicted one.

    Null texts, texts without a letter and, where no row has a language, all texts are in none, and go.
    """
    ship(spark)
    known = language.predict(docs, language.train(docs, held_out=None), COLUMNS)
    known = known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 or more stays, that of the least id, and documents that are in none.

    Of rows repeated under one id the least stays; rows without an id stay, and texts without words are in no group.
    """
    ship(spark)
    found = cut(near_text.near_duplicates(docs, percent=80))
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    marks = cut(found.where("not kept").select("doc_id").join(repeated, "doc_id", "left_anti").distinct().withColumn("again", F.lit(False)).union(repeated.withColumn("again", F.lit(True))))
    own = docs.select(*COLUMNS)
    marked = own.where("doc_id is not null").join(marks, "doc_id", "left")  # texts are shuffled once for both branches
    least = marked.where("again").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return own.where("doc_id is null").union(marked.where("again is null").select(*COLUMNS)).union(least.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that expected domain token totals match the targets.

    Rows of any content have a rate; without labels posteriors are uniform and rates near 1.
    """
    ship(spark)
    return mixing.resampled(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), PIPELINE_TARGETS).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' and decoded bytes' digests of every document; a null text is empty."""
    ship(spark)
    return byte_bpe.digests(docs, *byte_bpe.public_vocabulary())


#: Shares of the tokens by domain once low quality is gone.
PIPELINE_TARGETS = {"q1t0": 0.93, "q1t1": 0.07}

STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Trained models decide on rows, which SQL can't express; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{next(_runs)}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.mode("overwrite").parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    raise ValueError("STAGES is empty")


_runs = iter(range(1 << 30))
