"""Training and choosing a gradient-boosted classifier, and calibrating its scores."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .risk import log_loss


def assembled(rows: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(rows)


def train(rows: DataFrame, cols: list[str], label: str = "binary_label", rounds: int = 10, depth: int = 3, seed: int = 42, **params):
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed, **params).fit(assembled(rows, cols))


def score(model, rows: DataFrame, cols: list[str]) -> DataFrame:
    """``rows`` with p."""
    out = model.transform(assembled(rows, cols))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def choose(history: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Of candidates (id, loss, num_leaves, min_data, l2, best_round) within tolerance of the best loss, the simplest."""
    best = history.agg(F.min("loss").alias("best"))
    near = history.crossJoin(F.broadcast(best)).where(F.col("loss") <= F.col("best") + tolerance)  # one row
    return near.orderBy("num_leaves", F.desc("min_data"), F.desc("l2"), "best_round", "id").limit(1).drop("best")


def search(train_rows: DataFrame, valid: DataFrame, cols: list[str], grid: list[dict], label: str = "binary_label") -> tuple[DataFrame, dict]:
    """Fits every candidate, early-stopped on the validation rows, and chooses. Returns the history and the choice."""
    spark = train_rows.sparkSession
    both = train_rows.withColumn("is_valid", F.lit(False)).unionByName(valid.withColumn("is_valid", F.lit(True)))
    rows = []
    for i, g in enumerate(grid):
        m = train(both, cols, label, g.get("rounds", 10), g.get("depth", 3), minInstancesPerNode=g.get("min_data", 1), validationIndicatorCol="is_valid", validationTol=1e-6)
        loss = log_loss(score(m, valid, cols)).first()["log_loss"]
        rows.append((i, float(loss), 2 ** g.get("depth", 3), g.get("min_data", 1), float(g.get("l2", 0.0)), m.getNumTrees))
    history = spark.createDataFrame(rows, "id int, loss double, num_leaves int, min_data int, l2 double, best_round int")
    return history, grid[choose(history).first()["id"]]


def platt(rows: DataFrame, p: str = "p", label: str = "binary_label"):
    """Calibration by a logistic curve of the score. Returns rows -> rows with ``calibrated``."""
    m = LogisticRegression(featuresCol="features", labelCol=label).fit(assembled(rows, [p]))
    return lambda x: m.transform(assembled(x, [p])).withColumn("calibrated", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def isotonic(rows: DataFrame, p: str = "p", label: str = "binary_label"):
    """Calibration by a rising step curve of the score."""
    m = IsotonicRegression(featuresCol="f", labelCol=label, predictionCol="calibrated").fit(rows.withColumn("f", F.col(p)).withColumn(label, F.col(label).cast("double")))
    return lambda x: m.transform(x.withColumn("f", F.col(p))).drop("f")
