"""Toxicity: bidirectional gated recurrent network with attention pooling.

A word's input is its own vector (for words of the training sample) plus the
mean of its character n-gram vectors, so unseen words are read by their parts.
Windows of ``WINDOW`` words, each starting ``STRIDE`` words after the one
before, cover the whole text; the network reads a window in both directions,
attention weights pool the states, and a logistic unit scores it.  A document's
score is that of its highest window.  Training is numpy in one task, on a
bounded sample of the labelled rows (``PER_CLASS`` documents a class, the
smallest by hash of the id, with ``TRAIN_WINDOWS`` windows each); positive
documents teach through their highest windows, re-chosen every epoch.

Defined results: a null text counts as empty; an empty text is read as one empty
window and scored like any other; label rows without a document, documents
without a label, null labels and repeated labels are allowed (a document's label
is the largest given); with labels of one class or none, every score is that
class's share (0 without labels); an empty table gives an empty result; extra
columns are never inputs.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverylens.llm import gru
from deliverylens.llm.common import ByteTexts, documents, kept_alone, remainder, slices

WINDOW, STRIDE = 48, 24
#: Bound of the training sample: documents a class, windows a document.
PER_CLASS, TRAIN_WINDOWS = 2500, 24
WORDS, BUCKETS, DIM, HIDDEN = 16_000, 1 << 14, 8, 8
EPOCHS, MIN_STEPS, BATCH, RATE = 6, 150, 192, 0.01
#: Words whose gate inputs a worker remembers.
CACHE = 250_000
MARKS = b".,;:!?#$%&*|\"'()[]<>-_/\\"
F32 = np.float32


def plain(word: bytes) -> bytes:
    return word.strip(MARKS) or word


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 3- to 5-byte pieces of each marked word, and where each word's begin."""
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(w) for w in marked])
    stop = np.cumsum(size)
    left = np.repeat(stop, size) - np.arange(stop[-1])  # bytes from here to the word's end
    b = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), size)
    who, which = [], []
    acc = b.copy()
    for n in (2, 3, 4, 5):
        acc = acc[:-1] * np.uint32(0x01000193) if len(acc) > 1 else acc[:0]
        acc = acc ^ b[n - 1:n - 1 + len(acc)]
        if n >= 3:
            ok = left[:len(acc)] >= n
            h = acc[ok] * np.uint32(0x9E3779B1)
            who.append(owner[:len(acc)][ok])
            which.append((h ^ np.uint32(n * 7919)) >> np.uint32(32 - 14))
    who, which = np.concatenate(who), np.concatenate(which)
    order = np.argsort(who, kind="stable")
    return which[order].astype(np.int64), np.searchsorted(who[order], np.arange(len(words)))


def gram_means(table: np.ndarray, which: np.ndarray, begin: np.ndarray) -> np.ndarray:
    count = np.diff(np.append(begin, len(which)))
    return np.add.reduceat(table[which], begin, axis=0) / count[:, None].astype(F32)


def window_starts(n_words: int) -> np.ndarray:
    return np.arange(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE)


class Net:
    """The network; words come as rows of a table of word inputs, row 0 being padding."""

    def __init__(self, words: list[bytes], seed: int = 11):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, DIM
        self.word_row = {w: i + 1 for i, w in enumerate(words)}

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(F32)

        self.p = {"word": normal(len(words) + 1, d, scale=0.05), "gram": normal(BUCKETS, d, scale=0.05),
                  "wx": normal(d, 6 * h, scale=0.4), "bx": np.zeros(6 * h, F32), "uf": normal(h, 3 * h, scale=0.3),
                  "ub": normal(h, 3 * h, scale=0.3), "nf": np.zeros(h, F32), "nb": np.zeros(h, F32),
                  "att": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.zeros(1, F32)}
        self.p["word"][0] = 0

    def vectors(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        which, begin = grams(words)
        rows = np.array([self.word_row.get(w, 0) for w in words])
        return self.p["word"][rows] + gram_means(self.p["gram"], which, begin), (rows, which, begin)

    def gate_inputs(self, vectors: np.ndarray) -> np.ndarray:
        """Table [1 + words, 6H]; the padding row holds the state."""
        out = np.empty((len(vectors) + 1, 6 * HIDDEN), F32)
        out[1:] = vectors @ self.p["wx"] + self.p["bx"]
        out[0] = 0
        out[0, :HIDDEN] = out[0, 3 * HIDDEN:4 * HIDDEN] = 30
        return out

    def logits(self, table: np.ndarray, windows: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Score (log odds) of each window [n, WINDOW] of table rows."""
        p, h, h3 = self.p, HIDDEN, 3 * HIDDEN
        res = np.empty(len(windows), F32)
        ahead, back = np.ascontiguousarray(table[:, :h3]), np.ascontiguousarray(table[:, h3:])
        for lo in range(0, len(windows), batch):
            w = np.ascontiguousarray(windows[lo:lo + batch].T)
            steps, n = w.shape
            f, b = np.empty((steps, n, h), F32), np.empty((steps, n, h), F32)
            gru.states_only(lambda t: ahead[w[t]], steps, n, p["uf"], p["nf"], f)
            gru.states_only(lambda t: back[w[steps - 1 - t]], steps, n, p["ub"], p["nb"], b)
            b = b[::-1]
            a = f @ p["att"][:h] + b @ p["att"][h:] - F32(30) * (w == 0)
            a = np.exp(a - a.max(0))
            a /= a.sum(0)
            y = f @ p["out"][:h] + b @ p["out"][h:]
            res[lo:lo + batch] = (a * y).sum(0) + p["bias"][0]
        return res

    def gradients(self, words: list[bytes], windows: np.ndarray, label: np.ndarray,
                  weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean log-loss for a batch of windows over 1 + words."""
        p, h, h3 = self.p, HIDDEN, 3 * HIDDEN
        vec, (rows, which, begin) = self.vectors(words)
        table = self.gate_inputs(vec)
        w = windows.T
        steps, n = w.shape
        x = table[w]
        f, saved_f = gru.forward(x[..., :h3], p["uf"], p["nf"], np.zeros((n, h), F32))
        b, saved_b = gru.forward(x[::-1, :, h3:], p["ub"], p["nb"], np.zeros((n, h), F32))
        s = np.concatenate([f[1:], b[1:][::-1]], axis=2)
        a = s @ p["att"] - F32(30) * (w == 0)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        y = s @ p["out"]
        got = (a * y).sum(0)
        err = ((gru.sigmoid(got + p["bias"][0]) - label) * weight / n).astype(F32)
        d_a = a * (y - got) * err
        d_y = a * err
        d_s = d_a[..., None] * p["att"] + d_y[..., None] * p["out"]
        dx_f, d_uf, d_nf = gru.backward(d_s[..., :h], p["uf"], f, saved_f)
        dx_b, d_ub, d_nb = gru.backward(d_s[::-1, :, h:], p["ub"], b, saved_b)
        d_x = np.concatenate([dx_f, dx_b[::-1]], axis=2).reshape(-1, 6 * h)
        flat = w.reshape(-1)
        d_table = np.zeros_like(table)
        np.add.at(d_table, flat, d_x)
        d_table = d_table[1:]
        d_vec = d_table @ p["wx"].T
        d_word = np.zeros_like(p["word"])
        np.add.at(d_word, rows, d_vec)
        d_word[0] = 0
        count = np.diff(np.append(begin, len(which)))
        d_gram = np.zeros_like(p["gram"])
        np.add.at(d_gram, which, np.repeat(d_vec / count[:, None].astype(F32), count, axis=0))
        return {"word": d_word, "gram": d_gram, "wx": vec.T @ d_table, "bx": d_table.sum(0), "uf": d_uf, "ub": d_ub,
                "nf": d_nf, "nb": d_nb, "att": np.einsum("tn,tnk->k", d_a, s), "out": np.einsum("tn,tnk->k", d_y, s),
                "bias": np.array([err.sum()], F32)}


def train(docs: list[tuple[list[list[bytes]], int]], seed: int = 5) -> Net:
    """Fit on (windows of words, label) of each sampled document."""
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    windows, owner = [], []
    for k, (wins, _) in enumerate(docs):
        for win in wins:
            row = np.zeros(WINDOW, np.int64)
            row[:len(win)] = [vocab.setdefault(w, len(vocab) + 1) for w in win]
            windows.append(row)
            owner.append(k)
    windows, owner = np.array(windows), np.array(owner)
    label = np.array([y for _, y in docs])
    words = list(vocab)
    # document frequency a class; words kept as rows are those most often seen
    freq = np.zeros((2, len(words) + 1))
    pair = np.unique(owner[:, None] * (len(words) + 1) + windows)
    np.add.at(freq, (label[pair // (len(words) + 1)], pair % (len(words) + 1)), 1)
    total = np.maximum(1, np.bincount(label, minlength=2))[:, None]

    def odds(count: np.ndarray) -> np.ndarray:
        share = (count + 0.5) / (total + 1)
        return np.clip(np.log(share[1]) - np.log(share[0]), -3, 3) * np.minimum(1, count.sum(0) / 8)

    seen = freq[:, 1:].sum(0)
    kept = [words[i] for i in np.argsort(-seen, kind="stable")[:WORDS] if seen[i] >= 3]
    net = Net(kept)
    # the first component of every vector starts at the log odds of the classes
    which, begin = grams(words)
    spread = np.repeat(np.arange(len(words)), np.diff(np.append(begin, len(which))))
    gram_freq = np.zeros((2, BUCKETS))
    for y in (0, 1):
        np.add.at(gram_freq[y], which, freq[y, 1:][spread])
    net.p["gram"][:, 0] = odds(gram_freq)
    word_odds = odds(freq)
    net.p["word"][1:, 0] = word_odds[[vocab[w] for w in kept]]
    first = np.concatenate([[-9], net.vectors(words)[0][:, 0]])
    score = first[windows].max(1)
    # a quarter of a larger sample is kept from the steps, to place the cut by
    aside = rng.random(len(docs)) < 0.25 if label.sum() >= 100 <= len(label) - label.sum() else np.zeros(len(docs), bool)
    opt = gru.Adam(net.p, RATE)
    per_round = sum(2 if y == 0 else 1 for y in label)
    rounds = max(EPOCHS, -(-MIN_STEPS * BATCH // per_round))
    for epoch in range(rounds):
        pick = []
        order = np.lexsort((-score, owner))
        starts = np.searchsorted(owner[order], np.arange(len(docs)))
        stops = np.append(starts[1:], len(order))
        for k, (lo, hi) in enumerate(zip(starts, stops)):
            if hi <= lo or aside[k]:
                continue
            pick.append(order[lo])
            if label[k] == 0 and hi - lo > 1:
                pick.append(order[rng.integers(lo + 1, hi)])
        pick = rng.permutation(np.array(pick))
        share = label[owner[pick]].mean()
        opt.rate = RATE * (1 - 0.8 * epoch / rounds)
        for lo in range(0, len(pick), BATCH):
            part = windows[pick[lo:lo + BATCH]]
            ids, inv = np.unique(part, return_inverse=True)
            inv = inv.reshape(part.shape)
            if ids[0] != 0:
                inv, ids = inv + 1, np.insert(ids, 0, 0)
            if len(ids) == 1:
                continue
            y = label[owner[pick[lo:lo + BATCH]]].astype(F32)
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(F32)
            opt.step(net.gradients([words[i - 1] for i in ids[1:]], inv, y, weight))
        score = net.logits(net.gate_inputs(net.vectors(words)[0]), windows)
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, score)
    judge = aside if aside.any() else ~aside
    net.p["bias"] -= F32(cut_point(best[judge], label[judge]))
    return net


def cut_point(best: np.ndarray, label: np.ndarray) -> float:
    """Middle of the range of cuts that part the classes best (a clean document lost counts as four toxic ones missed)."""
    order = np.sort(np.unique(best))
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
    pos, neg = np.sort(best[label == 1]), np.sort(best[label == 0])
    missed = np.searchsorted(pos, cuts) / len(pos)
    false = 1 - np.searchsorted(neg, cuts) / len(neg)
    cost = missed + 4 * false
    good = cuts[cost <= cost.min() + 1e-12]
    low, high = best[best < good[0]], best[best >= good[-1]]
    return float(((low.max() if len(low) else good[0]) + (high.min() if len(high) else good[-1])) / 2)


class Scorer:
    """Scores whole texts; remembers the gate inputs of words."""

    def __init__(self, model: bytes):
        got = pickle.loads(model)
        self.constant = got if isinstance(got, float) else None
        if self.constant is None:
            self.net: Net = got
            self.rows: dict[bytes, int] = {}
            self.table = self.net.gate_inputs(np.zeros((0, DIM), F32))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        split = [t.lower().split() for t in texts]
        rows = self.rows
        if len(rows) > CACHE:
            rows.clear()
            self.table = self.table[:1]
        new = list({w for words in split for w in words if w not in rows})
        if new:
            more = self.net.gate_inputs(self.net.vectors([plain(w) for w in new])[0])[1:]
            rows.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, more])
        flat = np.array([rows[w] for words in split for w in words] + [0], np.int32)
        size = np.array([len(words) for words in split])
        base = np.cumsum(size) - size
        starts = [window_starts(n) for n in size]
        count = np.array([len(s) for s in starts])
        begin = np.concatenate(starts)
        doc = np.repeat(np.arange(len(texts)), count)
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < size[doc][:, None]
        at += base[doc][:, None]
        windows = np.where(inside, flat[np.where(inside, at, len(flat) - 1)], 0)
        best = np.maximum.reduceat(self.net.logits(self.table, windows), np.cumsum(count) - count)
        # float32 sums differ in the last places from batch to batch; the score is given to six
        return np.round(1 / (1 + np.exp(-best.astype(np.float64))), 6)


_SCORERS: dict[int, Scorer] = {}


def scorer(model: bytes) -> Scorer:
    key = zlib.crc32(model)
    if key not in kept_alone(_SCORERS):
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """Model from the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(remainder(5) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = None
    for y in (0, 1):  # bounded by PER_CLASS rows each
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumnRenamed("doc_id", "label_id")
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic"))

    def cut(batches):
        """A bounded number of windows of each sampled document, chosen by hash, as packed words."""
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                words = [plain(w) for w in text.encode().lower().split()]
                starts = window_starts(len(words))
                if len(starts) > TRAIN_WINDOWS:
                    starts = np.sort(np.random.default_rng(i & 0xFFFFFFFF).choice(starts, TRAIN_WINDOWS, replace=False))
                out.append(b"\n".join(b" ".join(words[s:s + WINDOW]) for s in starts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "windows": out})

    def learn(batches):
        rows = [r for pdf in batches for r in zip(pdf["doc_id"], pdf["toxic"], pdf["windows"])]
        rows.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
        docs = [([x.split(b" ") if x else [] for x in bytes(w).split(b"\n")], int(y)) for _, y, w in rows]
        share = float(np.mean([y for _, y in docs])) if docs else 0.0
        usable = any(any(w for w in wins) for wins, _ in docs)
        yield pd.DataFrame({"model": [pickle.dumps(train(docs) if usable and 0 < share < 1 else share)]})

    cut_rows = sample.mapInPandas(cut, "doc_id long, toxic int, windows binary")
    found = cut_rows.repartition(1).mapInPandas(learn, "model binary").collect()
    return bytes(found[0].model) if found else pickle.dumps(0.0)


def with_score(docs: DataFrame, model: bytes, name: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score of its ``text`` as a further column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    field = docs.schema.names.index("text")

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            texts = batch.column(field)
            raw = ByteTexts(texts)
            for lo, hi in slices(texts):
                got = score([raw[i] for i in range(lo, hi)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())],
                                                 names=[*batch.schema.names, name])

    schema = docs.schema.jsonValue()
    from pyspark.sql import types as T
    out = T.StructType.fromJson(schema).add(name, T.DoubleType())
    return docs.mapInArrow(run, out)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns as they were."""
    name = "toxic_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, fit(docs, labels), name).where(F.col(name) < 0.5).select(*docs.columns)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (with_score(rows, model, "score")
            .select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))
