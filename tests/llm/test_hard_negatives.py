import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deliverylens.llm import hard_negatives as H


def brute(rows, every=100, scale=256, n_pos=5, n_neg=5, low=80, high=100):
    """Plain Python integers over all pairs."""
    use = []
    for i, label, vec in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        use.append((i, label, [math.floor(scale * float(x)) for x in vec]))
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (ai, al, av) in enumerate(use):
        if ai is None or ai % every:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, label, b) for b, (i, label, v) in enumerate(use)]
        scored.sort(key=lambda t: (-t[0], late(t[1])))
        pos = [t for t in scored if t[2] == al and t[3] != a][:n_pos]
        for p in pos:
            neg = [t for t in scored if t[2] != al and low * p[0] <= 100 * t[0] <= high * p[0]][:n_neg]
            out += [(ai, p[1], r + 1, t[1], p[0], t[0]) for r, t in enumerate(neg)]
    return out


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"id long, label int, vector array<{kind}>").withColumn("slot", F.lit("x")).withColumn("d", F.lit("x"))
    out = H.hard_negatives(df.repartition(3), F.col("id") % 100 == 0, **more)
    return [tuple(r)[:6] for r in out.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_residue_products_are_exact():
    rnd = np.random.default_rng(3)
    for width, size in ((1, 5), (64, 300), (64, 3_000_000), (5000, 40_000), (9000, 2)):
        a, b = rnd.integers(-size, size + 1, (7, width)), rnd.integers(-size, size + 1, (11, width))
        a[0], b[0] = size, -size
        bound = math.isqrt(int((a.astype(object) ** 2).sum(1).max()) * int((b.astype(object) ** 2).sum(1).max())) + 1
        primes = H.moduli(bound, width)
        assert len(set(primes)) == len(primes) and (math.prod(primes) - 1) // 2 >= bound
        got = H.products(H.residues(a, primes), H.residues(b, primes), primes)
        assert (got == a @ b.T).all()


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (60, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(H, "ANCHOR_BLOCK", blocks[1])
    monkeypatch.setattr(H, "TILE_ROWS", 37)
    rnd = random.Random(5)
    near = [[rnd.gauss(0, 0.3) for _ in range(6)] for _ in range(8)]
    rows = [(i, rnd.randrange(4), [x + rnd.gauss(0, 0.05) for x in rnd.choice(near)]) for i in range(0, 700)]
    rows += [(1000, 1, None), (1100, None, [0.1] * 6), (1200, 1, [0.1, None] * 3), (1300, 1, [float("nan")] + [0.1] * 5),
             (1400, 2, [float("inf")] * 6), (1500, 2, [0.3, 0.2]), (1600, 2, []), (None, 2, near[0]), (None, 1, near[0]), (-100, 3, near[1])]
    rows += [rows[200], rows[200], rows[17], rows[17]]  # an anchor and another row, three times each
    rows += [(2000 + i, 0, near[2]) for i in range(30)]  # ties
    rows += [(None, rows[300][1], [1.05 * x for x in rows[300][2]]), (None, (rows[300][1] + 1) % 4, rows[300][2])]
    rows = [(i, label, vec and [x if x is None else float(np.float32(x)) for x in vec]) for i, label, vec in rows]
    want = brute(rows)
    assert len(want) > 100 and any(r[1] is None for r in want) and any(r[3] is None for r in want)
    assert ordered(run(spark, rows)) == ordered(want)


def test_large_components_and_other_parameters(spark):
    rnd = random.Random(6)
    rows = [(i * 50, rnd.randrange(2), [rnd.uniform(-9e4, 9e4) for _ in range(3)]) for i in range(60)]
    kw = dict(scale=1000, n_pos=2, n_neg=7, low=10, high=300)
    got = run(spark, rows, "double", scale=1000, n_positives=2, n_negatives=7, low=10, high=300)
    assert ordered(got) == ordered(brute(rows, **kw)) and got


def test_empty_and_without_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [0.5]), (2, 1, [0.5])]) == []
    assert run(spark, [(100, 1, [0.5])]) == []


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(100, 1, [1e17, 1.0]), (101, 1, [1e17, 2.0])], "double")
