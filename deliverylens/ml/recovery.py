"""Recovery classifier (ML2, ML5, ML6): second-order boosted trees.

Boosted trees predicting ``is_recovered`` from the FE6 columns: 150 rounds
of depth 6 and step 0.1 by default, with the positive class weighted by
negatives/positives of the training rows (as ``scale_pos_weight`` does) in
both the gradient and the hessian sums.  Missing inputs (no attempts, no
endpoint) take each cut's default side; see :mod:`.boosting`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import MODEL_FEATURES
from . import boosting
from .boosting import BoostedTrees

MISSING = -1.0


def impute(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Missing inputs as a sentinel, for the isolation forest, which has no side for them."""
    cols = features or MODEL_FEATURES
    return df.select(*[c for c in df.columns if c not in cols],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c) for c in cols])


def train_recovery_model(train: DataFrame, features: list[str] | None = None, label: str = "is_recovered",
                         max_iter: int = 150, max_depth: int = 6, step_size: float = 0.1, **options) -> BoostedTrees:
    """ML2: fit the classifier on labelled FE6 rows; ``options`` are those of :func:`.boosting.fit`."""
    cols = features or MODEL_FEATURES
    counts = train.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    scale = (counts["neg"] / counts["pos"]) if counts["pos"] else 1.0
    weighted = train.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(scale))).otherwise(F.lit(1.0)))
    return boosting.fit(weighted, cols, label, "_weight", rounds=max_iter, max_depth=max_depth, step_size=step_size, **options)


def score_recovery(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """ML5 + ML6: predicted class at 0.5, P(recovered) and risk = 1 - P."""
    return (df.withColumn("p_recovered", model.probability(df.sparkSession))
            .withColumn("prediction", (F.col("p_recovered") > 0.5).cast("double"))
            .withColumn("safe_to_replay", F.col("prediction") == 1.0)
            .withColumn("risk_score", F.lit(1.0) - F.col("p_recovered")))


def save_model(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    """Persist the fitted trees."""
    model.save(spark, path)


def load_model(spark: SparkSession, path: str) -> BoostedTrees:
    """Reload fitted trees."""
    return BoostedTrees.load(spark, path)
