import math
import zlib
from collections import Counter

import numpy as np
import pytest

from deliverylens.llm import gru, language_model as lm
from deliverylens.llm.language_model import Layout, log10_of, output, score_documents


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(lm, "WARM_STEPS", 40)
    monkeypatch.setattr(lm, "FREQUENT", 60)


def brute(texts):
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in texts]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in texts]
    c = Counter(w for ts, ok in zip(tokens, train) if ok for w in ts)
    n, v = sum(c.values()), len(c)
    return [(i, not ok, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts))
            for (i, _), ok, ts in zip(texts, train, tokens)]


def test_counts_and_base_equal_brute_force(docs, texts):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                  for r in score_documents(docs).collect()), key=key)
    want = sorted(brute(texts), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_empty(no_docs):
    assert score_documents(no_docs).count() == 0


def layout():
    return Layout([50, 40, 30, 20, 10, 5, 3, 2], 12, np.arange(lm.TAILS))


def test_probabilities_of_all_words_and_tails_sum_to_one():
    lay = layout()
    p = lm.new_weights(lay)
    h = np.random.default_rng(1).standard_normal((3, lm.HIDDEN)).astype(np.float32)
    for row in h:
        ln, _ = output(p, lay, np.repeat(row[None], lay.n_codes, 0), np.arange(lay.n_codes))
        assert abs(np.exp(ln.astype(float)).sum() - 1) < 1e-4


def test_state_is_carried_across_windows_and_cleared_between_documents():
    lay, rng = layout(), np.random.default_rng(2)
    p = lm.new_weights(lay)
    docs = [np.append(rng.integers(1, lay.n_codes, n), 0).astype(np.int32) for n in (3, 200, 0, 70, 5)]
    whole = log10_of(p, lay, docs, lanes=2, window=1000)
    assert np.allclose(whole, log10_of(p, lay, docs, lanes=2, window=7), atol=1e-4)
    assert np.allclose(whole, [log10_of(p, lay, [d])[0] for d in docs], atol=1e-4)


def test_gradients_equal_differences():
    lay, rng = layout(), np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in lm.new_weights(lay).items()}
    x = rng.standard_normal((4, 3, 3 * lm.HIDDEN)).astype(np.float32)
    code = rng.integers(0, lay.n_codes, 12)
    h0 = np.zeros((3, lm.HIDDEN), np.float32)

    def loss():
        s, _ = gru.forward(x, p["u"].astype(np.float32), p["bn"].astype(np.float32), h0)
        return -float(output(p, lay, s[1:].reshape(12, -1), code)[0].astype(float).mean())

    s, saved = gru.forward(x, p["u"].astype(np.float32), p["bn"].astype(np.float32), h0)
    g: dict = {}
    _, d_h = output(p, lay, s[1:].reshape(12, -1), code, g)
    _, g["u"], g["bn"] = gru.backward(d_h.reshape(4, 3, -1).astype(np.float32), p["u"].astype(np.float32), s, saved)
    for k, at in (("wc", (2, 1)), ("bw", (3,)), ("ww", (1, 2)), ("u", (4, 20)), ("bn", (5,))):
        old = p[k][at]
        p[k][at] = old + 1e-2
        up = loss()
        p[k][at] = old - 1e-2
        down = loss()
        p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


def test_model_beats_the_base_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = score_documents(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)  # both negative


SIZES = (lm.FREQUENT, lm.CLASSES, lm.TAILS, lm.WIDE)  # before the fixture makes them small


def test_model_has_its_full_size():
    assert SIZES == (2000, 40, 36, 128)
    assert len({lm.tail_class(b"ab" + m) for m in (b"", b",", b".")}) == 3
    assert len({lm.tail_class(b"a" * n) for n in (4, 8, 13, 14)}) == 4
    assert len({lm.tail_class(w.encode()) for w in ("abc", "aé", "éa")}) == 3
