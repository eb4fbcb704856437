"""Model behaviour on planted signal (ML2-ML6)."""
import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from deliverylens.ml import isolation_forest as IF
from deliverylens.ml import recovery as R
from deliverylens.operators.features import MODEL_FEATURES


def test_isolation_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(3)
    normal = rng.normal(0, 1, size=(2000, 2))
    outliers = rng.normal(0, 1, size=(10, 2)) + 8.0
    rows = [(f"n{i}", float(x), float(y)) for i, (x, y) in enumerate(normal)] + \
           [(f"o{i}", float(x), float(y)) for i, (x, y) in enumerate(outliers)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    nodes = IF.fit_isolation_forest(df, ["a", "b"], key=["id"], n_trees=50, sample_size=128)
    scored = IF.score_isolation_forest(df, nodes, ["a", "b"])
    top = [r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(10).collect()]
    assert sum(t.startswith("o") for t in top) >= 9
    nodes2, th = IF.train_isolation_forest(df, ["a", "b"], key=["id"], n_trees=50, sample_size=128)
    flagged = IF.score_anomaly(df, nodes2, th, ["a", "b"])
    share = flagged.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert abs(share - 0.05) < 0.01
    assert flagged.where("is_anomaly and anomaly_label <> -1").count() == 0


def test_recovery_model_learns_planted_signal(spark, scratch):
    rng = np.random.default_rng(5)
    n = 3000
    err = rng.uniform(0, 1, n)
    y = (err + rng.normal(0, 0.2, n) < 0.6).astype(int)
    rows = []
    for i in range(n):
        feats = {c: 0.0 for c in MODEL_FEATURES}
        feats["error_ratio"] = float(err[i])
        feats["payload_size_kb"] = float(rng.uniform(0, 500))
        rows.append((f"e{i}", "ep", int(y[i]), *[feats[c] for c in MODEL_FEATURES]))
    df = spark.createDataFrame(rows, ["event_id", "endpoint_id", "is_recovered"] + MODEL_FEATURES)
    model = R.train_recovery_model(df, max_iter=5, max_depth=3)
    path = f"{scratch}/model"
    R.save_model(spark, model, path)
    scored = R.score_recovery(R.load_model(spark, path), df)
    assert scored.where((F.col("risk_score") - (1 - F.col("p_recovered"))) != 0).count() == 0
    auc = BinaryClassificationEvaluator(rawPredictionCol="p_recovered", labelCol="label").evaluate(
        scored.withColumn("label", F.col("is_recovered").cast("double")))
    assert auc > 0.8


def test_forest_scores_match_naive_traversal(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(0, 1, size=(300, 3))
    df = spark.createDataFrame([(f"r{i}", *map(float, p)) for i, p in enumerate(pts)], "id string, a double, b double, c double")
    nodes = IF.fit_isolation_forest(df, ["a", "b", "c"], key=["id"], n_trees=7, sample_size=64)
    got = {r.id: r.anomaly_score for r in IF.score_isolation_forest(df, nodes, ["a", "b", "c"]).collect()}
    table = nodes.toPandas()
    trees = {t: g.set_index("node") for t, g in table.groupby("tree")}

    def path(tree, x, node=0):
        n = tree.loc[node]
        if n.feature < 0:
            return n.depth + float(IF.c_factor(np.array([n["size"]]))[0])
        nxt = n.left if x[int(n.feature)] < n.threshold else n.right
        return path(tree, x, int(nxt))

    c = float(IF.c_factor(np.array([64]))[0])
    for i in range(0, 300, 37):
        mean = np.mean([path(trees[t], pts[i]) for t in trees])
        assert abs(got[f"r{i}"] - 2.0 ** (-mean / c)) < 1e-12


def test_small_samples_are_normalised_by_their_own_size(spark):
    df = spark.createDataFrame([(f"r{i}", float(i)) for i in range(20)], "id string, a double")
    nodes = IF.fit_isolation_forest(df, ["a"], key=["id"], n_trees=5)
    assert IF.Forest(nodes.toPandas()).c_psi == float(IF.c_factor(np.array([20]))[0])


def test_whole_scorer_survives_save_and_load(spark, scratch):
    from paths import SF0001
    from deliverylens.ml import intelligence as INTEL
    from deliverylens.sources.testdata import load_tables
    t = load_tables(spark, SF0001)
    models = INTEL.fit_models(t, max_iter=2, n_trees=5, model_dir=f"{scratch}/scorer")
    again = INTEL.load_models(spark.newSession(), f"{scratch}/scorer")
    cols = ["event_id", "risk_score", "anomaly_score", "is_anomaly"]
    rows = INTEL.FE.select_model_columns(INTEL.FE.features_per_event(t))
    a = INTEL.score_events(rows, models).select(*cols)
    b = INTEL.score_events(rows, again).select(*cols)
    assert a.count() > 0 and a.exceptAll(b).count() == 0


def test_unknown_ids_get_the_fallback_row(spark):
    from deliverylens.ml.intelligence import with_fallback
    decided = spark.createDataFrame([("e1", "delivered", "none", True, False, "none", 0.9, 0.0)],
                                    "event_id string, delivery_state string, failure_reason string, safe_to_replay boolean, "
                                    "is_anomaly boolean, recommended_action string, endpoint_health double, timeout_ratio double")
    ids = spark.createDataFrame([("e1",), ("e9",), ("e9",)], "event_id string")
    got = {r.event_id: (r.delivery_state, r.is_fallback) for r in with_fallback(ids, decided).collect()}
    assert got == {"e1": ("delivered", False), "e9": ("failed", True)}


def test_scoring_leaves_other_columns_alone(spark):
    """F1: ids and labels passed the scorer as pandas objects, row by row; now they pass as they are."""
    rows = [(f"e{i}", None if i % 3 else i, [i], float(i % 17), float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id string, label int, more array<int>, a double, b double")
    nodes = IF.fit_isolation_forest(df, ["a", "b"], ["event_id"], n_trees=5, sample_size=64)
    scored = IF.score_isolation_forest(df, nodes, ["a", "b"])
    forest = IF.Forest(nodes.toPandas())
    for r in scored.collect():
        total = 0.0
        for root in forest.root:
            node = root
            while forest.feature[node] >= 0:
                node = forest.left[node] if (r.a, r.b)[forest.feature[node]] < forest.threshold[node] else forest.right[node]
            total += forest.leaf_len[node]
        assert abs(r.anomaly_score - 2.0 ** (-(total / 5) / forest.c_psi)) < 1e-12
        assert r[:5] == tuple(rows[int(r.event_id[1:])])
    assert "MapInPandas" not in scored._jdf.queryExecution().executedPlan().toString()
    assert forest.score(np.zeros((0, 2))).shape == (0,)
