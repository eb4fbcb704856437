"""Event intelligence (D4, R2, A12): both models + the decision rules.

The original answers one event at a time from a frozen feature snapshot
(events added later get a constant answer).  Here every event is scored in
one batch job, so new events are scored, and only ids that truly have no
feature row fall back to the constant answer (flagged ``is_fallback``).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import decisions as D
from ..operators import features as FE
from ..session import checkpoint_dir, staged
from ..tables import Tables
from . import isolation_forest as IF
from . import recovery as R
from .boosting import BoostedTrees
from .split import stratified_split

RULE_INPUTS = ["endpoint_health_score", "timeout_ratio", "error_ratio"]


@dataclass
class Models:
    recovery: BoostedTrees
    forest: DataFrame          # node table, read back from parquet
    threshold: float           # anomaly score cut (train quantile)

    def save(self, path: str) -> None:
        """The whole scorer -- classifier, forest and threshold -- under one folder."""
        spark = self.forest.sparkSession
        R.save_model(spark, self.recovery, os.path.join(path, "recovery"))
        self.forest.write.mode("overwrite").parquet(os.path.join(path, "forest"))
        spark.createDataFrame([(self.threshold,)], "threshold double").write.mode("overwrite").parquet(
            os.path.join(path, "threshold"))


def load_models(spark: SparkSession, path: str) -> Models:
    """A saved scorer, in any session."""
    return Models(recovery=R.load_model(spark, os.path.join(path, "recovery")),
                  forest=spark.read.parquet(os.path.join(path, "forest")),
                  threshold=float(spark.read.parquet(os.path.join(path, "threshold")).first().threshold))


def model_rows(features: DataFrame) -> DataFrame:
    """FE6 rows with the split column; computed once for the split's rank search and the reader."""
    return stratified_split(staged(FE.select_model_columns(features), "rows"))


def fit_models(t: Tables, max_iter: int = 150, n_trees: int = 100, contamination: float = 0.05,
               seed: int = 42, model_dir: str | None = None, rows: DataFrame | None = None) -> Models:
    """ML2 + ML3 on the training split of the (event, endpoint) feature table,
    which is computed once and read by both fits; ``rows`` are :func:`model_rows` of ``t``, if the caller has them."""
    spark = t.events.sparkSession
    folder = os.path.join(checkpoint_dir(spark), "models", uuid.uuid4().hex)
    rows = model_rows(FE.event_features(t)) if rows is None else rows
    train = rows.where(F.col("split") == "train")
    recovery = R.train_recovery_model(train, max_iter=max_iter)
    x = R.impute(train)
    nodes = IF.fit_isolation_forest(x, FE.MODEL_FEATURES, key=["event_id", "endpoint_id"],
                                    n_trees=n_trees, seed=seed)
    nodes.write.parquet(os.path.join(folder, "forest"))
    forest = spark.read.parquet(os.path.join(folder, "forest"))
    # ids and labels need not pass the scorer
    scored = IF.score_isolation_forest(x.select(*FE.MODEL_FEATURES), forest, FE.MODEL_FEATURES)
    threshold = IF.anomaly_threshold(scored, contamination).first()["q"]  # one number
    models = Models(recovery=recovery, forest=forest, threshold=float(threshold))
    if model_dir:
        models.save(model_dir)
    return models


def score_events(features: DataFrame, models: Models) -> DataFrame:
    """Both models over feature rows: safe_to_replay, p_recovered,
    risk_score, anomaly_score, is_anomaly; raw rule inputs kept."""
    keep = features.select("event_id", "endpoint_id", "is_recovered",
                           *[F.col(c).alias(f"raw_{c}") for c in RULE_INPUTS],
                           *FE.MODEL_FEATURES)
    rec = R.score_recovery(models.recovery, keep)
    scored = IF.score_isolation_forest(R.impute(rec), models.forest, FE.MODEL_FEATURES)
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(models.threshold))


def event_intelligence(t: Tables, models: Models, ids: DataFrame | None = None) -> DataFrame:
    """One decision row per event (or per requested id, with the
    constant fallback row for ids without features)."""
    fpe = FE.select_model_columns(FE.features_per_event(t))
    scored = score_events(fpe, models)
    rules_in = scored.select("event_id", "safe_to_replay", "is_anomaly",
                             *[F.col(f"raw_{c}").alias(c) for c in RULE_INPUTS])
    decided = D.apply_rules(rules_in)
    return decided if ids is None else with_fallback(ids, decided)


def with_fallback(ids: DataFrame, decided: DataFrame) -> DataFrame:
    """One row per requested id; ids without a decision row get the
    constant answer, flagged ``is_fallback``."""
    fb = S.FALLBACK_INTELLIGENCE
    req = ids.select(F.col("event_id")).dropDuplicates()
    j = req.join(decided, "event_id", "left")
    hit = F.col("delivery_state").isNotNull()

    def pick(col: str, default) -> F.Column:
        return F.when(hit, F.col(col)).otherwise(F.lit(default)).alias(col)

    return j.select("event_id", pick("delivery_state", fb["delivery_state"]),
                    pick("failure_reason", fb["failure_reason"]), pick("safe_to_replay", fb["safe_to_replay"]),
                    pick("is_anomaly", fb["is_anomaly"]), pick("recommended_action", fb["recommended_action"]),
                    pick("endpoint_health", fb["endpoint_health"]), pick("timeout_ratio", fb["timeout_ratio"]),
                    (~hit).alias("is_fallback"))


def event_analysis_report(t: Tables, decisions: DataFrame) -> DataFrame:
    """R2: the decision row with the event tenant's contact (tenants
    without a usable email are left out, as no mail could be sent)."""
    contacts = (t.users.where(F.col("email").isNotNull() & (F.trim("email") != ""))
                .select("user_id", "name", "email"))
    owner = t.events.select("event_id", "user_id")
    return (decisions.join(owner, "event_id").join(contacts, "user_id")
            .select("event_id", "user_id", "name", "email", "safe_to_replay", "is_anomaly",
                    "recommended_action", "endpoint_health"))


def anomaly_rate(t: Tables, models: Models, rows: DataFrame | None = None) -> DataFrame:
    """Anomalies flagged in the test split, count and percent; ``rows`` as for :func:`fit_models`."""
    rows = model_rows(FE.event_features(t)) if rows is None else rows
    scored = IF.score_isolation_forest(R.impute(rows.where(F.col("split") == "test")), models.forest, FE.MODEL_FEATURES)
    flagged = scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(models.threshold))
    return flagged.agg(F.count(F.lit(1)).alias("n_test"),
                       F.sum(F.col("is_anomaly").cast("bigint")).alias("n_anomalies")).withColumn(
        "anomaly_pct", F.col("n_anomalies") * 100.0 / F.col("n_test"))
