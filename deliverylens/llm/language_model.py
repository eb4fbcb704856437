"""LM scoring by a gated recurrent network with a class-factored output softmax.

A document is its words (A-Z lower-cased) and one end.  P(word | state) =
P(class | state) * P(word | class, state).  The ``FREQUENT`` most frequent words
are split by rank into classes of equal mass, each with a softmax of its own over
its words; every other word belongs to a tail class, told by its length, last
mark and script, in which it has its smoothed share of the class's corpus count:
(c + 1) / (N_class + V_class + 1), a word never seen being one more type.

The work is split by Spark:

* corpus counts: each task makes its words distinct, hashes (64 bits) are dealt
  to buckets by value and added up; all training rows take part;
* training: one task fits the first weights on a bounded, hash-chosen share of
  the documents (``WARM_DOCS``), then *every* training document is learnt from,
  each task running truncated backpropagation over its own rows from those
  weights, and the tasks' weights are averaged by tokens in two levels;
* scoring: documents run side by side through the network, the state carried
  from window to window to the end, so whole documents are scored;
* tail words are dealt to the same buckets as the counts, and what each adds to
  its document's score comes back as sums.

Hot words (the frequent ones) never leave their task; a tail bucket gets words
by hash, so it is even.  Weights and frequent words are bounded by parameters.

Defined results: a null text counts as empty (its score is that of the end
alone); repeated rows are scored each; rows repeated with one doc_id get equal
answers only if their texts are equal, sums being kept per (doc_id, text); with
no training rows counts are zero and the network stays as initialised; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverylens.llm import gru
from deliverylens.llm.common import (ByteTexts, documents, id_text, mix64, partitions, remainder, slices, staged,
                                     words_of)

FREQUENT, CLASSES, TAILS = 2000, 40, 36
DIM = HIDDEN = 16
#: Documents in the first fit and its steps at least, width of its batch, steps between truncations, rate;
#: width of the parallel pass.
WARM_DOCS, WARM_STEPS, LANES, STEPS, RATE = 3000, 1500, 64, 24, 0.01
WIDE = 128
#: Entries of a bucket, about: keeps a bucket's arrays near 32 MB.
BUCKET_ENTRIES = 2_000_000
END = b"\n"  # no word holds white space
F32 = np.float32
LOG10 = F32(1 / np.log(10))


def tail_class(word: bytes) -> int:
    """0..TAILS-1 by length, last mark and script."""
    n, last = len(word), word[-1:]
    size = 0 if n <= 4 else 1 if n <= 8 else 2 if n <= 13 else 3
    mark = 1 if last == b"," else 2 if not last.isalnum() and last < b"\x80" else 0
    script = 0 if word.isascii() else 1 if word[0] < 0x80 else 2
    return (size * 3 + mark) * 3 + script


class Words:
    """Codes of words: 0 the end, 1..F frequent by rank, then tail classes; remembers what it has seen."""

    def __init__(self, frequent: list[int], limit: int = 400_000):
        self.rank = {h: i + 1 for i, h in enumerate(frequent)}
        self.base, self.limit = len(frequent) + 1, limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.code, self.hash = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, hashes) of the words of all texts in a row, and how many each text has."""
        if len(self.place) > self.limit:
            self._clear()
        split = [words_of(t) for t in texts]
        size = np.array([len(x) for x in split], np.int64)
        flat, place = list(chain.from_iterable(split)), self.place
        at = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(map(flat.__getitem__, missing.tolist())))
            h = list(map(xxhash.xxh3_64_intdigest, new))
            code = [self.rank.get(x) or self.base + tail_class(w) for x, w in zip(h, new)]
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.code = np.concatenate([self.code, np.array(code, np.int32)])
            self.hash = np.concatenate([self.hash, np.array(h, np.uint64)])
            at[missing] = [place[flat[i]] for i in missing.tolist()]
        return self.code[at], self.hash[at], size


class Layout:
    """Classes of the codes: frequent words by equal mass, then one class a tail, the end with the first words."""

    def __init__(self, counts: list[int], ends: int = 0, tail_n: np.ndarray | None = None):
        mass = np.cumsum(np.array(counts or [1], float))
        share = np.minimum(CLASSES - 1, (mass - np.array(counts or [1])) / mass[-1] * CLASSES).astype(int)
        cls = np.concatenate([[0], share[:len(counts)]]) if counts else np.zeros(1, int)
        cls = np.unique(cls, return_inverse=True)[1]  # no class is left without words
        self.heads = cls.max() + 1
        self.cls = np.concatenate([cls, self.heads + np.arange(TAILS)]).astype(np.int32)
        self.n_classes = self.heads + TAILS
        self.n_codes = len(self.cls)
        self.first = np.searchsorted(cls, np.arange(self.heads))  # codes of a head class are a range
        self.stop = np.append(self.first[1:], len(cls))
        # where training starts: the corpus shares of words and classes
        seen = np.array([ends, *counts], float) + 1
        self.word_ln = np.log(seen).astype(F32)
        heads = np.bincount(cls, seen, self.heads)
        self.class_ln = np.log(np.append(heads, np.zeros(TAILS) if tail_n is None else tail_n) + 1.0).astype(F32)
        self.class_ln -= self.class_ln.max()


def new_weights(layout: Layout, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(F32)

    frequent = int(layout.stop[-1])
    return {"emb": normal(layout.n_codes, DIM, scale=0.3), "wx": normal(DIM, 3 * HIDDEN, scale=0.3),
            "bx": np.zeros(3 * HIDDEN, F32), "u": normal(HIDDEN, 3 * HIDDEN, scale=0.25), "bn": np.zeros(HIDDEN, F32),
            "wc": normal(HIDDEN, layout.n_classes, scale=0.1), "bc": layout.class_ln.copy(),
            "ww": normal(HIDDEN, frequent, scale=0.1), "bw": layout.word_ln.copy()}


def output(p: dict, layout: Layout, h: np.ndarray, code: np.ndarray, grads: dict | None = None):
    """ln P(class) + ln P(word | class) of each row (tail words: the class alone); with ``grads``,
    the gradient of the mean loss on h, adding the weights' own to ``grads``."""
    rows = np.arange(len(code))
    cls = layout.cls[code]
    # weights keep logits small; the bound only guards against overflow
    logit = np.minimum(h @ p["wc"] + p["bc"], F32(60))
    e = np.exp(logit)
    total = e @ np.ones(e.shape[1], F32)
    ln = logit[rows, cls] - np.log(total)
    d_h = None
    if grads is not None:
        share = F32(1 / len(code))
        d = e * (share / total)[:, None]
        d[rows, cls] -= share
        grads["wc"] = h.T @ d
        grads["bc"] = d.sum(0)
        d_h = d @ p["wc"].T
        grads["ww"], grads["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
    order = np.argsort(cls, kind="stable")
    edge = np.searchsorted(cls[order], np.arange(layout.heads + 1))
    for k in range(layout.heads):
        a, b = layout.first[k], layout.stop[k]
        at = order[edge[k]:edge[k + 1]]
        if b - a < 2 or not len(at):
            continue
        hk = h[at]
        lg = np.minimum(hk @ p["ww"][:, a:b] + p["bw"][a:b], F32(60))
        ek = np.exp(lg)
        tk = ek @ np.ones(b - a, F32)
        own = (np.arange(len(at)), code[at] - a)
        ln[at] += lg[own] - np.log(tk)
        if grads is not None:
            dk = ek * (share / tk)[:, None]
            dk[own] -= share
            grads["ww"][:, a:b] = hk.T @ dk
            grads["bw"][a:b] = dk.sum(0)
            d_h[at] += dk @ p["ww"][:, a:b].T
    return ln, d_h


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Deal documents (codes ending with 0) to lanes, longest first, each to the shortest lane.

    Returns targets [T, L], inputs [T, L] (the code before; 0 at a start), starts [T, L] and the
    (lane, offset) of each document; -1 marks padding in targets."""
    import heapq

    lanes = max(1, min(lanes, len(docs)))
    place = [(0, 0)] * len(docs)
    heap = [(0, i) for i in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        used, lane = heapq.heappop(heap)
        place[d] = (lane, used)
        heapq.heappush(heap, (used + len(docs[d]), lane))
    steps = max(used for used, _ in heap)
    target = np.full((steps, lanes), -1, np.int32)
    before = np.zeros((steps, lanes), np.int32)
    start = np.zeros((steps, lanes), bool)
    for codes, (lane, at) in zip(docs, place):
        target[at:at + len(codes), lane] = codes
        before[at + 1:at + len(codes), lane] = codes[:-1]
        start[at, lane] = True
    return target, before, start, place


def learn(p: dict, layout: Layout, docs: list[np.ndarray], opt: gru.Adam, lanes: int) -> None:
    """One pass of truncated backpropagation; the state is carried across truncations."""
    target, before, start, _ = lanes_of(docs, lanes)
    h = np.zeros((target.shape[1], HIDDEN), F32)
    active = np.arange(target.shape[1])
    for lo in range(0, len(target), STEPS):
        on = (target[lo:lo + STEPS, active] >= 0).any(0)
        active, h = active[on], h[on]
        t, b = target[lo:lo + STEPS, active], before[lo:lo + STEPS, active]
        keep = (~start[lo:lo + STEPS, active]).astype(F32)[..., None]
        x = (p["emb"] @ p["wx"] + p["bx"])[b]
        states, saved = gru.forward(x, p["u"], p["bn"], h, keep)
        live = t >= 0
        grads: dict[str, np.ndarray] = {}
        _, d_live = output(p, layout, states[1:][live], t[live], grads)
        d_states = np.zeros(states[1:].shape, F32)
        d_states[live] = d_live
        d_x, grads["u"], grads["bn"] = gru.backward(d_states, p["u"], states, saved, keep)
        flat = d_x.reshape(-1, 3 * HIDDEN)
        grads["bx"] = flat.sum(0)
        by_code = np.zeros((layout.n_codes, 3 * HIDDEN), F32)
        order = np.argsort(b.reshape(-1), kind="stable")
        codes, first = np.unique(b.reshape(-1)[order], return_index=True)
        by_code[codes] = np.add.reduceat(flat[order], first, axis=0)
        grads["wx"] = p["emb"].T @ by_code
        grads["emb"] = by_code @ p["wx"].T
        opt.step(grads)
        h = states[-1]


def log10_of(p: dict, layout: Layout, docs: list[np.ndarray], lanes: int = 512, window: int = 64) -> np.ndarray:
    """log10 probability of each whole document's codes, the state carried from window to window."""
    target, before, start, place = lanes_of(docs, lanes)
    table = p["emb"] @ p["wx"] + p["bx"]
    steps, width = target.shape
    ln = np.zeros((steps + 1, width))
    h = np.zeros((width, HIDDEN), F32)
    active = np.arange(width)
    for lo in range(0, steps, window):
        t = target[lo:lo + window]
        on = (t[:, active] >= 0).any(0)
        active, h = active[on], h[on]
        t, b, s = t[:, active], before[lo:lo + window, active], start[lo:lo + window, active]
        keep = (~s).astype(F32)[..., None]
        states, _ = gru.forward(table[b], p["u"], p["bn"], h, keep)
        h = states[-1]
        live = t >= 0
        got, _ = output(p, layout, states[1:][live], t[live])
        part = np.zeros(t.shape)
        part[live] = got
        ln[lo + 1:lo + 1 + len(t), active] = part
    total = np.cumsum(ln, axis=0)
    return np.array([total[at + len(c), lane] - total[at, lane] for c, (lane, at) in zip(docs, place)]) * float(LOG10)


# --- corpus counts -------------------------------------------------------------------------------

def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def dealt(hashes: np.ndarray, buckets: int):
    """(bucket, slice) of hashes sorted by value."""
    b = bucket_of(hashes, buckets)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(first, np.append(first[1:], len(b))):
        yield int(b[lo]), slice(lo, hi)


def blobs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of a bucket number and binary arrays."""
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])],
                                      names=["bucket", *names])


def by_document(d: np.ndarray, c: np.ndarray, known: np.ndarray, logs: np.ndarray):
    """Sums of each (doc_id, text_crc)."""
    order = np.lexsort((c, d))
    d, c = d[order], c[order]
    first = np.flatnonzero((np.diff(d, prepend=d[:1] - 1) != 0) | (np.diff(c, prepend=c[:1] - 1) != 0)) if len(d) else np.zeros(0, int)
    if not len(first):
        return d, c, known, logs
    return d[first], c[first], np.add.reduceat(known[order], first), np.add.reduceat(logs[order], first)


def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their summed counts, and an index of one place of each."""
    order = np.argsort(hashes, kind="stable")
    names, first = np.unique(hashes[order], return_index=True)
    return names, np.add.reduceat(counts[order], first) if len(first) else counts[:0], order[first]


def corpus_counts(train: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, counts, tails) of the words of all training rows; a word is in one bucket."""

    def count(batches):
        found: Counter = Counter()

        def flush():
            words = list(found)
            h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
            c = np.fromiter(found.values(), np.int64, len(words))
            tail = np.array([255 if w == END else tail_class(w) for w in words], np.uint8)
            order = np.argsort(h)
            h, c, tail = h[order], c[order], tail[order]
            rows = [(b, h[s].tobytes(), c[s].tobytes(), tail[s].tobytes()) for b, s in dealt(h, buckets)]
            found.clear()
            return blobs(rows, ["hashes", "counts", "tails"])

        for batch in batches:
            raw = ByteTexts(batch.column(0))
            for i in range(batch.num_rows):
                found.update(words_of(raw[i]))
            found[END] += batch.num_rows
            if len(found) > 400_000:
                yield flush()
        if found:
            yield flush()

    def merge(batches):
        """One bucket's rows follow each other; add them up bucket by bucket."""
        at, h, c, t = None, [], [], []

        def done():
            names, total, one = added(np.concatenate(h), np.concatenate(c))
            return pd.DataFrame({"bucket": [at], "hashes": [names.tobytes()], "counts": [total.tobytes()],
                                 "tails": [np.concatenate(t)[one].tobytes()]})

        for pdf in batches:
            for b, x, y, z in zip(pdf["bucket"], pdf["hashes"], pdf["counts"], pdf["tails"]):
                if at is not None and b != at:
                    yield done()
                    h, c, t = [], [], []
                at = b
                h.append(np.frombuffer(x, np.uint64))
                c.append(np.frombuffer(y, np.int64))
                t.append(np.frombuffer(z, np.uint8))
        if at is not None:
            yield done()

    schema = "bucket int, hashes binary, counts binary, tails binary"
    parts = min(buckets, max(partitions(train.sparkSession), buckets // 4))
    return (train.select("text").mapInArrow(count, schema).repartition(parts, "bucket")
            .sortWithinPartitions("bucket").mapInPandas(merge, schema))


def corpus_summary(counts: DataFrame):
    """(N, V, frequent hashes, their counts, per tail class N and V without the frequent words)."""

    def top(batches):
        """A task's most frequent words, and its totals by class."""
        n, v = np.zeros(256, np.int64), np.zeros(256, np.int64)
        best = np.zeros((0, 3), np.int64)
        for pdf in batches:
            for x, y, z in zip(pdf["hashes"], pdf["counts"], pdf["tails"]):
                h, c, t = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), np.frombuffer(z, np.uint8)
                np.add.at(n, t, c)
                v += np.bincount(t, minlength=256)
                best = np.concatenate([best, np.stack([h, c, t.astype(np.int64)], 1)])
                best = best[np.lexsort((best[:, 0], -best[:, 1]))[:FREQUENT + 1]]
        yield pd.DataFrame({"h": best[:, 0], "c": best[:, 1], "t": best[:, 2].astype(np.int32), "kind": 0})
        k = np.flatnonzero(v)
        yield pd.DataFrame({"h": v[k], "c": n[k], "t": k.astype(np.int32), "kind": 1})

    rows = staged(counts.mapInPandas(top, "h long, c long, t int, kind int"), "count_tops")
    totals = {r.t: (int(r.n), int(r.v)) for r in
              rows.where("kind = 1").groupBy("t").agg(F.sum("c").alias("n"), F.sum("h").alias("v")).collect()}
    best = rows.where("kind = 0 and t < 255").orderBy(F.desc("c"), "h").limit(FREQUENT).collect()  # bounded
    n, v = sum(x for x, _ in totals.values()), sum(x for _, x in totals.values())
    tail_n = np.array([totals.get(k, (0, 0))[0] for k in range(TAILS)], np.int64)
    tail_v = np.array([totals.get(k, (0, 0))[1] for k in range(TAILS)], np.int64)
    for r in best:
        tail_n[r.t] -= r.c
        tail_v[r.t] -= 1
    return n, v, [r.h & 0xFFFFFFFFFFFFFFFF for r in best], [int(r.c) for r in best], totals.get(255, (0, 0))[0], tail_n, tail_v


# --- training ------------------------------------------------------------------------------------

def coded(words: Words, texts: list[bytes]) -> list[np.ndarray]:
    code, _, size = words.of(texts)
    stop = np.cumsum(size)
    flat = np.insert(code, stop, 0)  # each document's end
    return np.split(flat, (stop + np.arange(1, len(size) + 1))[:-1])


def fit(train: DataFrame, frequent: list[int], layout: Layout) -> dict[str, np.ndarray]:
    """Weights learnt from every training row: a first fit, then all rows in parallel, averaged."""
    spark = train.sparkSession

    def warm(batches):
        words, p = Words(frequent), new_weights(layout)
        texts = sorted(t.encode() for pdf in batches for t in pdf["text"])
        opt = gru.Adam(p, RATE)
        docs = coded(words, texts)
        turns = max(2, -(-WARM_STEPS * LANES * STEPS // max(1, sum(map(len, docs)))))
        for turn in range(min(turns, 12)):
            opt.rate = RATE * (1 - 0.7 * turn / turns)
            for lo in range(0, len(docs), 1500):
                learn(p, layout, docs[lo:lo + 1500], opt, LANES)
        yield pd.DataFrame({"weights": [pickle.dumps(p)]})

    chosen = train.select(F.col("doc_id").alias("chosen")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    first = (train.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("chosen"), "left_semi").select("text")
             .repartition(1).mapInPandas(warm, "weights binary").collect())
    start = spark.sparkContext.broadcast(bytes(first[0].weights) if first else pickle.dumps(new_weights(layout)))

    def part(batches):
        words, p = Words(frequent), pickle.loads(start.value)
        opt = gru.Adam(p, RATE / 4)
        tokens = 0
        for batch in batches:
            texts = batch.column(0)
            raw = ByteTexts(texts)
            for lo, hi in slices(texts, 12 << 20):
                docs = coded(words, [raw[i] for i in range(lo, hi)])
                tokens += sum(map(len, docs))
                learn(p, layout, docs, opt, WIDE)
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(tokens)]), pa.array([pickle.dumps({k: x * F32(tokens) for k, x in p.items()})], pa.binary())],
                names=["tokens", "weights"])

    def add(batches):
        total, tokens = None, 0.0
        for pdf in batches:
            for n, w in zip(pdf["tokens"], pdf["weights"]):
                got = pickle.loads(w)
                total = got if total is None else {k: total[k] + got[k] for k in total}
                tokens += n
        if total is not None:
            yield pd.DataFrame({"tokens": [tokens], "weights": [pickle.dumps(total)]})

    schema = "tokens double, weights binary"
    parts = staged(train.select("text").mapInArrow(part, schema), "weights")
    width = max(1, int(len(parts.inputFiles()) ** 0.5))
    total = parts.repartition(width).mapInPandas(add, schema).coalesce(1).mapInPandas(add, schema).collect()
    if not total:
        return pickle.loads(start.value)
    return {k: (x / F32(total[0].tokens)).astype(F32) for k, x in pickle.loads(total[0].weights).items()}


# --- scoring -------------------------------------------------------------------------------------

def score_documents(docs: DataFrame, held: int = 2, modulus: int = 7) -> DataFrame:
    """One row per row of ``docs``; see the module's text.  ``text_crc`` keeps rows of one doc_id apart."""
    spark = docs.sparkSession
    base = id_text(docs)
    train = base.where(remainder(modulus) != held)
    bytes_in = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(spark), int(bytes_in / 10 // BUCKET_ENTRIES) + 1)
    counts = staged(corpus_counts(train, buckets), "counts")
    n, v, frequent, freq_counts, end_count, tail_n, tail_v = corpus_summary(counts)
    layout = Layout(freq_counts, end_count, tail_n)
    weights = fit(train, frequent, layout)
    model = spark.sparkContext.broadcast(pickle.dumps((weights, layout, frequent, freq_counts, end_count)))
    tail_ln = np.log10(tail_n + tail_v + 1.0)
    tails = len(frequent) + 1

    def run(batches):
        p, layout, frequent, freq_counts, end_count = pickle.loads(model.value)
        words = Words(frequent)
        lg = np.zeros(tails + TAILS)
        lg[0] = np.log10(end_count + 1.0)
        lg[1:tails] = np.log10(np.array(freq_counts, float) + 1)
        minus = np.concatenate([np.zeros(tails), tail_ln])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            raw = ByteTexts(texts)
            for lo, hi in slices(texts, 12 << 20):
                part = [raw[i] for i in range(lo, hi)]
                docs = coded(words, part)
                ln = log10_of(p, layout, docs)
                size = np.array([len(c) for c in docs])
                flat, first = np.concatenate(docs), np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([zlib.crc32(t) for t in part], pa.int64()), pa.array(size, pa.int64()),
                     pa.array(np.add.reduceat((flat < tails).astype(np.int64), first) - (end_count == 0), pa.int64()),
                     pa.array(np.add.reduceat(lg[flat], first)), pa.array(ln - np.add.reduceat(minus[flat], first))],
                    names=["doc_id", "text_crc", "n_tokens", "known", "log_counts", "log_model"])

    heads = base.mapInArrow(run, "doc_id long, text_crc long, n_tokens long, known long, log_counts double, log_model double")

    def spread(batches):
        """Distinct tail words of each document, dealt to the buckets of the counts."""
        words = Words(frequent)
        hs, ds, cs, ts, held_n = [], [], [], [], 0

        def flush():
            h, d, c, t = map(np.concatenate, (hs, ds, cs, ts))
            order = np.argsort(h, kind="stable")
            h, d, c, t = h[order], d[order], c[order], t[order]
            rows = []
            for b, s in dealt(h, buckets):
                o = np.lexsort((c[s], d[s]))  # equal ids together: they shrink well
                rows.append((b, h[s][o].tobytes(), d[s][o].tobytes(), c[s][o].tobytes(), t[s][o].tobytes()))
            return blobs(rows, ["hashes", "docs", "crcs", "times"])

        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            raw = ByteTexts(batch.column(1))
            for lo, hi in slices(batch.column(1)):
                texts = [raw[i] for i in range(lo, hi)]
                code, h, size = words.of(texts)
                doc = np.repeat(np.arange(hi - lo), size)[code >= tails]
                h = h[code >= tails]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(h, prepend=~h[:1]) != 0)) if len(h) else np.zeros(0, int)
                hs.append(h[first])
                ts.append(np.diff(np.append(first, len(h))).astype(np.uint32))
                ds.append(ids[lo:hi][doc[first]])
                cs.append(np.array([zlib.crc32(t) for t in texts], np.uint32)[doc[first]])
                held_n += len(first)
                if held_n > 800_000:
                    yield flush()
                    hs, ds, cs, ts, held_n = [], [], [], [], 0
        if held_n:
            yield flush()

    def look_up(key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(known["hashes"].iloc[0], np.uint64) if len(known) else np.zeros(0, np.uint64)
        count = np.frombuffer(known["counts"].iloc[0], np.int64) if len(known) else np.zeros(0, np.int64)
        ds, cs, ks, ls = [], [], [], []
        for x, d, c, t in zip(asked["hashes"], asked["docs"], asked["crcs"], asked["times"]):
            h, t = np.frombuffer(x, np.uint64), np.frombuffer(t, np.uint32).astype(np.int64)
            got = np.zeros(len(h), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                got = np.where(names[at] == h, count[at], 0)
            ds.append(np.frombuffer(d, np.int64))
            cs.append(np.frombuffer(c, np.uint32).astype(np.int64))
            ks.append(t * (got > 0))
            ls.append(t * np.log10(got + 1.0))
        if not ds:
            return pd.DataFrame(columns=["bucket", "docs", "crcs", "known", "logs"])
        d, c, k, lg = by_document(*map(np.concatenate, (ds, cs, ks, ls)))
        to = mix64(d.view(np.uint64))  # dealt back by document
        order = np.argsort(to, kind="stable")
        d, c, k, lg, to = d[order], c[order], k[order], lg[order], to[order]
        rows = [(b, *(x[s].tobytes() for x in (d, c, k, lg))) for b, s in dealt(to, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "docs", "crcs", "known", "logs"])

    def gather(batches):
        """One bucket's rows follow each other: sums of each document."""
        at, parts = None, []

        def done():
            cols = [np.concatenate([np.frombuffer(x[i], kind) for x in parts])
                    for i, kind in enumerate((np.int64, np.int64, np.int64, np.float64))]
            return pd.DataFrame(dict(zip(("doc_id", "text_crc", "tail_known", "tail_log"), by_document(*cols))))

        for pdf in batches:
            for b, *x in zip(pdf["bucket"], pdf["docs"], pdf["crcs"], pdf["known"], pdf["logs"]):
                if at is not None and b != at:
                    yield done()
                    parts = []
                at = b
                parts.append(x)
        if at is not None:
            yield done()

    asked = base.mapInArrow(spread, "bucket int, hashes binary, docs binary, crcs binary, times binary")
    tail_rows = (asked.groupBy("bucket").cogroup(counts.groupBy("bucket"))
                 .applyInPandas(look_up, "bucket int, docs binary, crcs binary, known binary, logs binary"))
    sums = (tail_rows.repartition(max(partitions(spark), buckets // 4), "bucket").sortWithinPartitions("bucket")
            .mapInPandas(gather, "doc_id long, text_crc long, tail_known long, tail_log double"))
    # a repeated (doc_id, text) sums its copies; dividing by their number gives each its own
    low = F.lit(np.iinfo(np.int64).min).cast("long")
    heads = staged(heads, "heads")
    copies = heads.groupBy("doc_id", "text_crc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sums = sums.withColumn("doc_id", F.when(F.col("doc_id") == low, F.lit(None)).otherwise(F.col("doc_id")))
    both = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_crc"] == b["text_crc"])
    sums = (sums.join(copies, both(sums, copies), "left")
            .select(sums["doc_id"], sums["text_crc"],
                    (F.col("tail_known") / F.coalesce("copies", F.lit(1))).cast("long").alias("tail_known"),
                    (F.col("tail_log") / F.coalesce("copies", F.lit(1))).alias("tail_log")))
    per_token = float(np.log10(n + v + 1.0))
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0).cast("long"))
    return (heads.join(sums, both(heads, sums), "left")
            .select(heads["doc_id"], "n_tokens", (F.col("known") + tail_known).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("log_counts") + tail_log - F.col("n_tokens") * per_token).alias("base_score"),
                    (F.col("log_model") + tail_log).alias("score"))
            .select("doc_id", (remainder(modulus) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score"))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
