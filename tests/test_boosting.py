"""Second-order boosting (ML2) against a small numpy version that grows each tree by recursion over raw rows."""
import numpy as np
import pytest

from deliverylens.ml import boosting as B


def naive(x, y, w, cuts, rounds, depth, step, lam, mcw, scale):
    """Margins of all rows; x is rows x features with NaN for missing."""
    margin = np.zeros(len(x))

    def leaf(at, g, h):
        return -step * (g[at].sum() / scale) / (h[at].sum() / scale + lam)

    def grow(at, left, g, h, out):
        best = None
        gain_of = lambda a, b: a * a / (b + lam)
        gt, ht = g[at].sum() / scale, h[at].sum() / scale
        for f in range(x.shape[1]) if left else ():
            for c in cuts[f]:
                for missing_left in (False, True):
                    v = x[at, f]
                    go = np.where(np.isnan(v), missing_left, v < c)
                    gl, hl = g[at[go]].sum() / scale, h[at[go]].sum() / scale
                    if hl < mcw or ht - hl < mcw:
                        continue
                    gain = gain_of(gl, hl) + gain_of(gt - gl, ht - hl) - gain_of(gt, ht)
                    if gain > B.NO_GAIN and (best is None or gain > best[0] + 1e-9):
                        best = (gain, at[go], at[~go])
        if best is None:
            out[at] += leaf(at, g, h)
            return
        grow(best[1], left - 1, g, h, out)
        grow(best[2], left - 1, g, h, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (p - y) * scale), np.rint(w * p * (1 - p) * scale)
        grow(np.arange(len(x)), depth, g, h, margin)
    return margin


def data(n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.exponential(size=n)], axis=1)
    x[rng.random(n) < 0.2, 0] = np.nan
    x[rng.random(n) < 0.1, 2] = np.nan
    z = np.nan_to_num(x[:, 0], nan=1.5) + (x[:, 1] == 2) - 0.5 * np.nan_to_num(x[:, 2], nan=-1)
    y = (z + rng.normal(0, 0.5, n) > 0.3).astype(float)
    return x, y, np.where(y == 1, 0.7, 1.0)


def frame(spark, x, y, w, parts=5):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t), float(u)) for i, (r, t, u) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int, w double").repartition(parts)


@pytest.mark.parametrize("rewrite_every", [2, 50])
def test_equals_the_numpy_version(spark, rewrite_every):
    x, y, w = data()
    model = B.fit(frame(spark, x, y, w), ["a", "b", "c"], "label", "w", rounds=5, max_depth=3, step_size=0.3, bins=12, rewrite_every=rewrite_every)
    cuts = B.cut_points(frame(spark, x, y, w), ["a", "b", "c"], 11)
    want = naive(x, y, w, cuts, 5, 3, 0.3, 1.0, 1.0, 2.0 ** 36)
    got = model.margins(x.T)
    assert np.abs(got - want).max() < 1e-8
    scored = frame(spark, x, y, w).select("id", model.probability(spark).alias("p")).collect()
    assert max(abs(r.p - 1 / (1 + np.exp(-want[r.id]))) for r in scored) < 1e-8


def test_partitioning_changes_nothing(spark):
    x, y, w = data(400, 9)
    kw = dict(rounds=4, max_depth=4, bins=32)
    a = B.fit(frame(spark, x, y, w, 1), ["a", "b", "c"], "label", "w", **kw)
    b = B.fit(frame(spark, x, y, w, 7), ["a", "b", "c"], "label", "w", **kw)
    assert a.nodes(spark).collect() == b.nodes(spark).collect()


def test_bins_and_values_lead_to_the_same_leaf(spark):
    x, y, w = data(300, 2)
    model = B.fit(frame(spark, x, y, w), ["a", "b", "c"], "label", "w", rounds=3, max_depth=4)
    cuts = B.cut_points(frame(spark, x, y, w), ["a", "b", "c"], 254)
    bins = np.stack([np.where(np.isnan(v), B.MISSING_BIN, np.searchsorted(c, v, side="right")) for v, c in zip(x.T, cuts)], axis=1).astype(np.uint8)
    for tree in model.trees:
        assert (B.walk_bins(tree, bins) == B.walk(tree, x.T)).all()


def test_edges(spark):
    x, y, w = data(50, 3)
    one = B.fit(frame(spark, x, np.ones(50), w), ["a", "b", "c"], "label", "w", rounds=2)
    assert (one.margins(x.T) > 0).all()  # one label: it grows surer of it, whatever the row
    assert len(set(np.round(one.margins(x.T), 12))) == 1
    none = B.fit(frame(spark, x, y, w).where("id < 0"), ["a", "b", "c"], "label", "w", rounds=2)
    assert (none.margins(x.T) == 0).all()
    with_null = frame(spark, x, y, w).selectExpr("id", "a", "b", "c", "if(id % 2 = 0, label, null) as label", "w")
    half = B.fit(with_null, ["a", "b", "c"], "label", "w", rounds=2, max_depth=2)
    again = B.fit(with_null.where("label is not null"), ["a", "b", "c"], "label", "w", rounds=2, max_depth=2)
    assert half.nodes(spark).count() == again.nodes(spark).count()


def test_saved_trees_score_alike(spark, scratch):
    x, y, w = data(200, 5)
    model = B.fit(frame(spark, x, y, w), ["a", "b", "c"], "label", "w", rounds=3)
    model.save(spark, f"{scratch}/trees")
    again = B.BoostedTrees.load(spark, f"{scratch}/trees")
    assert again.features == ["a", "b", "c"] and (again.margins(x.T) == model.margins(x.T)).all()


def test_the_driver_gets_one_total_of_all_tasks(spark, monkeypatch):
    """Whatever the number of partitions, and with only the bins that exist."""
    from pyspark.core.rdd import RDD
    x, y, w = data(400)
    got, collect = [], RDD.collect

    def spied(self):
        out = collect(self)
        got.append((len(out), sum(v.size for _, v in out)))
        return out

    monkeypatch.setattr(RDD, "collect", spied)
    cuts = [np.array([0.0, 1.0]), np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.5])]
    blocks = B.unpacked(B.as_blocks(frame(spark, x, y, w, 24), ["a", "b", "c"], "label", "w", cuts, 0.0))
    assert blocks.getNumPartitions() == 24
    sums = B.histograms(blocks, (np.array([-1]),) * 7, [0], [2, 4, 1], 1024.0)
    assert got == [(1, 2 * (4 + 6 + 3))]
    g = np.rint(w * (0.5 - y) * 1024)
    for f, c in enumerate(cuts):
        at = np.where(np.isnan(x[:, f]), B.MISSING_BIN, np.searchsorted(c, x[:, f], side="right"))
        assert (sums[0, f, 0] == np.bincount(at, g, 256)).all()


def test_features_that_share_a_sum():
    assert B.shared_columns([254, 2, 2, 2, 2, 5, 7]) == [[1, 2, 3, 4], [5, 6], [0]]
    assert B.shared_columns([]) == []


def test_best_cuts_of_several_nodes_are_those_of_each():
    rng = np.random.default_rng(3)
    g, h = rng.integers(-50, 50, (6, 3, 256)).astype(float), rng.integers(0, 9, (6, 3, 256)).astype(float)
    g[:, 1], h[:, 1] = g[:, 0], h[:, 0]  # a tie of two features
    g[5], h[5] = 0, 0
    every = B.best_cuts(g, h, [254, 254, 0], 1.0, 1.0)
    assert every == [B.best_cuts(g[i:i + 1], h[i:i + 1], [254, 254, 0], 1.0, 1.0)[0] for i in range(6)]
    assert every[5] is None and all(c[1] == 0 for c in every[:5])


@pytest.mark.parametrize("tasks", [1, 3])
def test_tasks_together_grow_the_trees_of_single_jobs(spark, tasks, monkeypatch):
    """One barrier stage instead of a job a level, with the same trees; the driver gets only them."""
    x, y, w = data(500, 6)
    kw = dict(rounds=6, max_depth=5, bins=40)
    monkeypatch.setattr(B, "tasks_together", lambda spark: tasks)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"together {tasks}", "")
    try:
        one = B.fit(frame(spark, x, y, w), ["a", "b", "c"], "label", "w", **kw)
        n = len(jobs.getJobIdsForGroup(f"together {tasks}"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    monkeypatch.setattr(B, "tasks_together", lambda spark: 0)
    other = B.fit(frame(spark, x, y, w), ["a", "b", "c"], "label", "w", **kw)
    assert [[list(a) for a in t] for t in one.trees] == [[list(a) for a in t] for t in other.trees]
    assert n < 25  # 6 rounds of 5 levels were 30 jobs, besides those of the quantiles
