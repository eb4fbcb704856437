"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A document leaks an item if some run of its words is within ``k = floor(0.2 * m)``
word edits of the item's ``m`` words (words lower-cased, outer marks stripped).
Windows of ``m`` words are embedded by Chakraborty-Goldenberg-Koucky random
walks, which turn edit distance into Hamming distance; several walks, several
sampled position sets each, give the keys under which windows meet items of the
same length.  Pairs that meet are verified by exact alignment, so a reported
pair is always right.  ``tables_for`` sets the number of repetitions from the
target recall.

Windows are placed only where they can match: k edits spoil at most g*k of an
item's g-word runs (q-gram lemma), so a document sharing fewer than
``m - g + 1 - g*k`` runs with an item is out, and a window starts where a shared
run says the item would start.  Runs have the most words, three at most, for which
that number is at least one: two for items of two or five words, one for items of
one word, three for all others.  Items of fewer than five words allow no edit and
are searched for equality; ``min_words`` leaves out items that are too short to
tell (by default none).  The items are the stated query side: they are
broadcast in blocks of ``BLOCK_BYTES`` of text, each block searched against all
rows; documents are never shuffled.

Defined results: a null or empty text leaks nothing; an item without words (or
null) matches nothing; repeated
rows are each searched; an empty table on either side gives an empty result;
extra columns pass through :func:`drop_leaks`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deliverylens.llm.common import ByteTexts, documents, kept_alone, mix64, shingle_hashes, slices, words_of

EDIT_SHARE, MIN_WORDS, GRAM = 0.2, 1, 3
#: Walks, sampled positions a key, and the recall aimed at when the embedded words differ in DIFFER of the positions.
WALKS, POSITIONS, RECALL, DIFFER = 6, 3, 0.99, 0.5
#: Item text that one pass over the documents takes.
BLOCK_BYTES = 32 << 20
MARKS = b".,;:!?#$%&*|\"'()[]<>"
PAD = np.uint64(0)


def edits_of(m: int) -> int:
    return int(EDIT_SHARE * m + 1e-9)


def tables_for(recall: float, differ: float, positions: int) -> int:
    """Key tables needed so that a pair differing in ``differ`` of the positions meets with ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - differ) ** positions)))


def embed_keys(words: np.ndarray, walks: int, tables: int, positions: int, seed: int = 17) -> np.ndarray:
    """Keys [n, tables] of word-hash sequences [n, m] by CGK walks and sampled positions."""
    n, m = words.shape
    padded = np.concatenate([words, np.full((n, 1), PAD)], axis=1)
    rows = np.arange(n)
    rng = np.random.default_rng(seed + m)  # the same walks wherever sequences of this length are embedded
    keys = np.zeros((n, tables), np.uint64)
    per_walk = -(-tables // walks)
    for walk in range(walks):
        mine = range(walk * per_walk, min(tables, (walk + 1) * per_walk))
        chosen = [set(rng.choice(3 * m, min(positions, 3 * m), replace=False).tolist()) for _ in mine]
        salt = rng.integers(1, 2 ** 63, 3 * m, dtype=np.uint64)
        at = np.zeros(n, np.int64)
        for j in range(3 * m):
            symbol = padded[rows, at]
            for t, where in zip(mine, chosen):
                if j in where:
                    keys[:, t] = mix64(keys[:, t] ^ (symbol * np.uint64(0x9E3779B97F4A7C15)) ^ salt[j])
            at = np.minimum(at + (mix64(symbol ^ salt[j]) >> np.uint64(63)).astype(np.int64), m)
    return keys


def alignment(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, stop) of the best match of the whole item inside ``part``."""
    n = len(part)
    ramp = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int64)
    rows = [cost]
    for w in item:
        step = cost + 1
        step[1:] = np.minimum(step[1:], cost[:-1] + (part != w))
        cost = np.minimum.accumulate(step - ramp) + ramp
        rows.append(cost)
    stop = int(np.argmin(cost))
    i, j = len(item), stop
    while i > 0:
        here = rows[i][j]
        if j > 0 and here == rows[i - 1][j - 1] + (part[j - 1] != item[i - 1]):
            i, j = i - 1, j - 1
        elif here == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return int(cost[stop]), j, stop


class Words:
    """Hashes of plain words (0: nothing but marks), remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for w in set(words).difference(known):
            p = w.strip(MARKS)
            known[w] = (xxhash.xxh3_64_intdigest(p) or 1) if p else 0
        out = np.array(list(map(known.__getitem__, words)), np.uint64)
        return out[out != 0]


def gram_of(m: int) -> int:
    """Words of the runs by which windows are placed for an item of m words."""
    return next(g for g in range(GRAM, 0, -1) if m - g + 1 - g * edits_of(m) >= 1)


class Runs:
    """The sorted runs of ``words`` words of some items, with the item and the place of each."""

    def __init__(self, words: int, who: np.ndarray, seqs: list[np.ndarray]):
        self.words = words
        grams = [shingle_hashes(seqs[i], words) for i in who]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.owner = np.repeat(who, [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.gram >> np.uint64(44)).astype(np.int64)] = True


class Finder:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.words = Words()
        self.items, seqs = [], []
        for item_id, text in items:
            seq = self.words(words_of((text or "").encode()))
            if len(seq) >= max(min_words, 1):
                self.items.append(item_id)
                seqs.append(seq)
        self.seqs = seqs
        self.size = np.array([len(s) for s in seqs], np.int64)
        grams = np.array([gram_of(m) for m in self.size], np.int64)
        self.need = np.array([m - g + 1 - g * edits_of(m) for m, g in zip(self.size, grams)], np.int64)
        self.tables = tables_for(RECALL, DIFFER, POSITIONS)
        self.runs = [Runs(g, np.flatnonzero(grams == g), seqs) for g in np.unique(grams).tolist()]
        # keys of the items, by length
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in np.unique(self.size):
            who = np.flatnonzero(self.size == m)
            self.by_size[int(m)] = (who, embed_keys(np.stack([seqs[i] for i in who]), WALKS, self.tables, POSITIONS))

    def candidates(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """(doc, m, start) of the windows that share enough runs with an item of m words."""
        found = [self._candidates(runs, flat, begin, size) for runs in self.runs]
        found = [f for f in found if f is not None]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found), axis=0).T)

    def _candidates(self, runs: "Runs", flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        if len(flat) < runs.words:
            return None
        g = shingle_hashes(flat, runs.words)
        at = np.flatnonzero(runs.maybe[(g >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(runs.gram, g[at], "left")
        hi = np.searchsorted(runs.gram, g[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return None
        doc = np.searchsorted(begin, at, "right") - 1
        ok = at + runs.words <= (begin + size)[doc]  # a run may not cross two documents
        at, lo, hi, doc = at[ok], lo[ok], hi[ok], doc[ok]
        n = hi - lo
        rep = np.repeat(np.arange(len(at)), n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[rep]
        item, off = runs.owner[post], runs.place[post]
        d, start = doc[rep], at[rep] - begin[doc[rep]] - off
        # distinct item runs that the document shares
        pair = d * len(self.seqs) + item
        distinct = np.unique(np.stack([pair, off], 1), axis=0)[:, 0]
        names, shared = np.unique(distinct, return_counts=True)
        enough = names[shared >= self.need[names % len(self.seqs)]]
        ok = np.isin(pair, enough)
        return np.stack([d[ok], self.size[item[ok]], start[ok]], 1) if ok.any() else None

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item_id, edits, start word, number of words, item words), the best match of each text and item."""
        docs = [self.words(words_of(t)) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        begin = np.cumsum(size) - size
        flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
        doc, length, start = self.candidates(flat, begin, size)
        best: dict[tuple[int, int], tuple] = {}
        for m in np.unique(length):
            m = int(m)
            mine = np.flatnonzero(length == m)
            who, item_keys = self.by_size[m]
            for lo in range(0, len(mine), 4096):
                d, s = doc[mine[lo:lo + 4096]], start[mine[lo:lo + 4096]]
                at = s[:, None] + np.arange(m)
                inside = (at >= 0) & (at < size[d][:, None])
                window = np.where(inside, flat[np.clip(at + begin[d][:, None], 0, len(flat) - 1)], PAD)
                keys = embed_keys(window, WALKS, self.tables, POSITIONS)
                met = set()
                for t in range(self.tables):
                    order = np.argsort(item_keys[:, t], kind="stable")
                    left = np.searchsorted(item_keys[order, t], keys[:, t], "left")
                    right = np.searchsorted(item_keys[order, t], keys[:, t], "right")
                    for w in np.flatnonzero(right > left):
                        met.update((int(w), int(who[order[x]])) for x in range(left[w], right[w]))
                for w, i in sorted(met):
                    self._verify(best, int(d[w]), i, int(s[w]), docs[d[w]])
        return [(d, self.items[i], *found, int(self.size[i])) for (d, i), found in sorted(best.items())]

    def _verify(self, best: dict, doc: int, i: int, start: int, words: np.ndarray) -> None:
        item, m = self.seqs[i], len(self.seqs[i])
        k = edits_of(m)
        had = best.get((doc, i))
        if had is not None and had[0] == 0 and had[1] <= start:
            return
        exact = words[max(0, start):max(0, start) + m]
        if len(exact) == m and np.array_equal(exact, item):
            found = (0, max(0, start), m)
        else:
            lo = max(0, start - k)
            edits, a, b = alignment(item, words[lo:max(lo, start + m + k)])
            if edits > k:
                return
            found = (edits, lo + a, b - a)
        if had is None or found < had:
            best[(doc, i)] = found


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items dealt to blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(block == i) if n > 1 else items for i in range(n)]


def _finders(benchmark: DataFrame):
    for block in item_blocks(benchmark):
        rows = [(r.item_id, r.text) for r in block.collect()]  # bounded by BLOCK_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))


_FINDERS: dict[int, Finder] = {}


def _finder(shared, min_words: int) -> Finder:
    key = hash((min_words, *shared.value))
    if key not in kept_alone(_FINDERS):
        _FINDERS.clear()
        _FINDERS[key] = Finder(shared.value, min_words)
    return _FINDERS[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, edits, start_word, n_words, item_words): each document and item that it leaks, its best match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in _finders(benchmark):
        def run(batches, shared=shared):
            find = _finder(shared, min_words)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                raw = ByteTexts(texts)
                for lo, hi in slices(texts):
                    got = find([raw[i] for i in range(lo, hi)])
                    if got:
                        d, *rest = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([lo + x for x in d])), *(pa.array(x, pa.int64()) for x in rest)],
                            names=["doc_id", "item_id", "edits", "start_word", "n_words", "item_words"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits long, start_word long, n_words long, item_words long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that leak no item, columns as they were."""
    field = docs.schema.names.index("text")
    for shared in _finders(benchmark):
        def run(batches, shared=shared):
            find = _finder(shared, min_words)
            for batch in batches:
                raw = ByteTexts(batch.column(field))
                for lo, hi in slices(batch.column(field)):
                    clean = np.ones(hi - lo, bool)
                    clean[[x[0] for x in find([raw[i] for i in range(lo, hi)])]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
