"""Helpers shared by the training-data operators: staged tables, text columns,
word splitting and hashing, and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverylens.session import checkpoint_dir

#: UTF-8 bytes of a text that one numpy step handles at a time.
CHUNK_BYTES = 2 << 20


_KEPT: list[dict] = []


def kept_alone(table: dict) -> dict:
    """``table``, what an operator keeps in a worker process between tasks; what other operators kept there goes,
    so that a worker that has run several of them holds the tables of one."""
    if not any(t is table for t in _KEPT):
        _KEPT.append(table)
    for other in _KEPT:
        if other is not table:
            other.clear()
    return table


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage so that a lost executor costs one stage, and gives the
    optimizer measured sizes for the joins that follow."""
    spark = session_of(df)
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a document table; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(modulus: int, col: str = "doc_id"):
    """crc32 of the id written as decimal text, modulo ``modulus`` (a null id counts as '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def slices(texts: pa.Array, max_bytes: int = CHUNK_BYTES):
    """(start, stop) ranges of a string array holding about ``max_bytes`` each."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(np.diff(offsets_of(texts)))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def offsets_of(texts: pa.Array) -> np.ndarray:
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if big else np.int32
    buf = texts.buffers()[1]
    if buf is None:
        return np.zeros(len(texts) + 1, kind)
    return np.frombuffer(buf, kind)[texts.offset:texts.offset + len(texts) + 1]


class ByteTexts:
    """The UTF-8 bytes of each text of a string array, without decoding."""

    def __init__(self, texts: pa.Array):
        self.off = offsets_of(texts)
        data = texts.buffers()[2]
        self.data = memoryview(data) if data is not None else memoryview(b"")
        self.nulls = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None

    def __getitem__(self, i: int) -> bytes:
        if self.nulls is not None and self.nulls[i]:
            return b""
        return bytes(self.data[int(self.off[i]):int(self.off[i + 1])])


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased.

    bytes.lower() changes A-Z only and bytes.split() cuts at exactly those
    six white-space bytes, so other scripts pass through unchanged."""
    return text.lower().split()


class WordHash:
    """64-bit hashes of words, remembered for the frequent ones."""

    def __init__(self, limit: int = 1 << 18):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        out = [known.get(w) for w in words]
        if None in out:
            h = xxhash.xxh3_64_intdigest
            if len(known) > self.limit:
                known.clear()
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    v = out[i] = h(w)
                    known[w] = v
        return np.array(out, np.uint64)


_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-word shingles; fewer words make one shingle, none make none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(word_hashes.tobytes(), seed=n)], np.uint64)
    m = n - k + 1
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc = (acc ^ (word_hashes[j:j + m] * _MUL[j % 5])) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def local_forest(batches):
    """One partition's edges (a, b) reduced to star edges of its own components."""
    a, b = [], []
    for pdf in batches:
        a.append(pdf["a"].to_numpy())
        b.append(pdf["b"].to_numpy())
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return
    names, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(names), inv[:len(a)], inv[len(a):])
    keep = root != np.arange(len(names))
    yield pd.DataFrame({"a": names[keep], "b": names[root[keep]]})


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component (nodes 0..n-1, edges a-b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids.

    ``edges`` has columns a, b.  Returns (node, component) for every node
    with at least one edge to another node; component is its smallest node.
    Each round contracts every task's own edges to stars, hooks each node to
    its smallest neighbour (grouped minimum with map-side combine), jumps
    pointers and relabels the edges.  State is written to the shared folder
    once a round; the number of rounds is logarithmic."""
    spark = session_of(edges)
    live = staged(edges.where("a <> b").mapInPandas(local_forest, "a long, b long").distinct(), "edges")
    parents: DataFrame | None = None
    for _ in range(max_rounds):
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low"))
        hook = staged(hook.select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "hook")
        for _ in range(40):
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            jumped = staged(hook.join(up, "parent", "left")
                            .select("node", F.coalesce("up", "parent").alias("parent"),
                                    (F.coalesce("up", "parent") != F.col("parent")).alias("moved")), "jump")
            moved = jumped.where("moved").limit(1).count()
            hook = jumped.select("node", "parent")
            if not moved:
                break
        if parents is None:
            parents = hook
        else:
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
            parents = staged(parents.join(up, "parent", "left")
                             .select("node", F.coalesce("up", "parent").alias("parent")), "parents")
        to = hook.select(F.col("node"), F.col("parent"))
        live = (live.join(to.withColumnRenamed("node", "a"), "a").select(F.col("parent").alias("x"), "b")
                .join(to.withColumnRenamed("node", "b"), "b").select(F.col("x").alias("a"), F.col("parent").alias("b"))
                .where("a <> b").distinct())
        live = staged(live, "edges")
        if not live.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return parents.select("node", F.col("parent").alias("component"))

