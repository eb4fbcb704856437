import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deliverylens.llm import toxicity as tox


@pytest.fixture(scope="module")
def labelled(spark, words):
    """Documents of which the toxic ones hold a bad word or an unseen ending somewhere."""
    rnd, rows, labels = random.Random(5), [], []
    for i in range(700):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                text.insert(rnd.randrange(len(text)), rnd.choice(["grobword", "vilex" + rnd.choice(words), "vilex" + rnd.choice(words)]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    model = tox.fit(docs, labels)
    held = [(truth[r.doc_id], r.toxic_score) for r in tox.with_score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.mean([(s >= 0.5) == (y == 1) for y, s in held])
    assert right > 0.93
    kept = {r.doc_id for r in tox.keep_clean(docs, labels).collect()}
    assert sum(truth[i] == 0 for i in kept) / len(kept) > 0.95


def test_edge_cases(spark, docs, no_docs, texts):
    odd = spark.createDataFrame([(1, 1), (1, 0), (8, None), (None, 1), (9999, 1), (20, 0), (21, 1), (22, 0), (23, 1)],
                                "doc_id long, toxic int")
    model = tox.fit(docs, odd)
    got = tox.with_score(docs, model, "s").collect()
    assert len(got) == len(texts) and all(0 <= r.s <= 1 for r in got)
    same = {}
    for r in got:
        assert abs(same.setdefault(r.text or "", r.s) - r.s) < 3e-6
    assert tox.keep_clean(docs, odd).columns == docs.columns
    assert tox.keep_clean(no_docs, odd).count() == 0


def test_one_class_or_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.s for r in tox.with_score(docs, tox.fit(docs, none), "s").collect()} == {0.0}
    only = spark.createDataFrame([(i, 1) for i in range(10, 40)], "doc_id long, toxic int")
    assert {r.s for r in tox.with_score(docs, tox.fit(docs, only), "s").collect()} == {1.0}


def test_windows_cover_every_word():
    for n in range(0, 400):
        starts = tox.window_starts(n)
        covered = {x for s in starts for x in range(s, s + tox.WINDOW)}
        assert set(range(n)) <= covered and (np.diff(starts) == tox.STRIDE).all()


def test_scores_do_not_depend_on_the_batch(labelled):
    docs, labels, _ = labelled
    model = tox.fit(docs, labels)
    texts = [r.text.encode() for r in docs.limit(30).collect()] + [b"", b"   "]
    whole = tox.Scorer(model)(texts)
    assert np.allclose(whole, [tox.Scorer(model)([t])[0] for t in texts], atol=1e-5)


def test_gradients_equal_differences():
    net = tox.Net([b"alpha", b"beta", b"gamma"])
    words, rng = [b"alpha", b"beta", b"gamma", b"delta"], np.random.default_rng(4)
    win = rng.integers(0, 5, (6, 7))
    win[:, 0] = 1
    y, w = np.array([0, 1, 1, 0, 1, 0], np.float32), np.ones(6, np.float32)
    g = net.gradients(words, win, y, w)

    def loss():
        z = net.logits(net.gate_inputs(net.vectors(words)[0]), win).astype(float)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    for k, at in (("out", (3,)), ("att", (2,)), ("wx", (1, 30)), ("uf", (2, 5)), ("ub", (1, 20)), ("word", (2, 1)), ("nb", (3,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3
