"""Token ids as ORC files: written in document order, read back stripe by stripe.

Documents are range-partitioned by doc_id (ties by text), so every task encodes
and writes one run of the order as one ORC file: column ``ids`` holds the ids
as an integer array, which ORC stores with integer run-length encoding, in
stripes with a row index; ``doc_id`` also has a Bloom filter.  A reader takes
the stripes in parallel, and a filter on doc_id is pushed down to file, stripe
and row-group metadata.  Texts move through the one range exchange; ids never do.

White space ends every token of the vocabulary, so each space-delimited word is
encoded alone and remembered, the frequent ones once per worker process.

Defined results: a null text counts as empty (only the end id is written); rows
repeated with the same doc_id are written each, next to each other; a null
doc_id comes first; an empty table gives an empty result; extra columns are not
written.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverylens.llm.common import ByteTexts, documents, id_text, slices, staged
from deliverylens.session import checkpoint_dir

#: Words whose ids a worker remembers.
CACHE = 600_000
#: ORC layout: stripe bytes, rows per index entry, false positives of the Bloom filter.
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 16 << 20, 1000, 0.01
#: Bytes of text per file, about.
FILE_BYTES = 64 << 20


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}  # word -> ids as little-endian 32-bit integers

    def encode(self, text: str) -> list[int]:
        """Same ids as encoding the text whole: white space parts all tokens, special ones hold none."""
        return np.frombuffer(self.packed([text.encode()])[0], "<u4").tolist()

    def packed(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; words are cut at ASCII white space, new ones are encoded together."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        split = [t.split() for t in texts]
        new = set(chain.from_iterable(split)).difference(cache)
        if new:
            self._learn(new)
        return [b"".join(map(cache.__getitem__, words)) for words in split]

    def _learn(self, new: set[bytes]) -> None:
        """Encode new words: their closing marks, which the vocabulary always parts from a letter, apart."""
        cache = self.cache
        cut: list[tuple[bytes, bytes, bytes]] = []
        letters, others = set(), set()
        for w in new:
            core = w.rstrip(_CLOSING)
            if core.isalpha():  # ASCII letters
                core = core.lower()
                if core not in cache:
                    letters.add(core)
            elif core and not core.isascii() and _PLAIN_LETTERS.fullmatch(text := core.decode()):
                core = text.lower().encode()
                if core not in cache:
                    letters.add(core)
            else:
                others.add(w)
                continue
            tail = w[len(core):]
            if tail and tail not in cache:
                others.add(tail)
            cut.append((w, core, tail))
        if letters:
            # runs of letters are one unit each, closed by one unit-ending token: one call encodes them all
            names = list(letters)
            ids = np.array(self._ids([b" ".join(names)])[0], "<u4")
            stops = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(stops) == len(names):
                flat = ids.tobytes()
                cache.update(zip(names, [flat[4 * x:4 * y] for x, y in zip([0, *stops], stops)]))
            else:
                others |= letters
        if others:
            names = list(others)
            cache.update(zip(names, [np.array(x, "<u4").tobytes() for x in self._ids(names)]))
        cache.update([(w, cache[core] + cache[tail] if tail else cache[core]) for w, core, tail in cut])

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [e.ids for e in coded]


_CLOSING = b".,;:!?"
#: Letters that normalisation leaves one letter.
_PLAIN_LETTERS = re.compile("[A-Za-z\u00df-\u00f6\u00f8-\u00ff\u00c0-\u00d6\u00d8-\u00de]+")
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of each row, ``end_id`` appended; keeps partitions and order."""

    def run(batches):
        enc, end = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            ids_col, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in slices(texts):
                raw = ByteTexts(texts)
                coded = enc.packed([raw[i] for i in range(lo, hi)])
                ends = np.cumsum([0, *(len(c) // 4 + 1 for c in coded)], dtype=np.int32)
                flat = np.frombuffer(end.join([*coded, b""]), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids_col.slice(lo, hi - lo), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int) -> str:
    """Write (doc_id, ids) of every row in ascending doc_id order as ORC files; returns the folder."""
    base = id_text(docs)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.sparkContext.defaultParallelism), -(-total // FILE_BYTES))
    ordered = base.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    (with_ids(ordered, path, end_id).write
     .option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", BLOOM_FPP)
     .option("compression", "zstd").orc(folder))
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of the files; filters on doc_id prune files, stripes and row groups."""
    return spark.read.schema("doc_id long, ids array<int>").orc(folder)


def ids_crc32(ids_column: pa.Array) -> list[int]:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    off = ids_column.offsets.to_numpy()
    flat = ids_column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    return [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])]


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the sum over earlier files (one row per file, which the ids'
    order ranks) and, within a file, over earlier rows."""

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("block"), batch.column("row"), pa.array(n),
                 pa.array(ids_crc32(ids), pa.int64())],
                names=["doc_id", "file", "block", "row", "n_tokens", "ids_crc32"])

    # the writer numbers its files in range order; equal doc_ids keep their place in the file
    rows = (read_token_files(spark, folder)
            .select("doc_id", "ids",
                    F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"))
            .withColumn("row", F.monotonically_increasing_id()))
    rows = staged(rows.mapInArrow(digest, "doc_id long, file int, block long, row long, n_tokens long, ids_crc32 long"),
                  "token_rows")
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()  # one row per file
    before, starts = 0, {}
    for r in sorted(per_file, key=lambda r: r.file):
        starts[r.file] = before
        before += r.n
    base = spark.createDataFrame(list(starts.items()) or [(-1, 0)], "file int, base long")
    inside = W.partitionBy("file").orderBy("doc_id", "block", "row").rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(F.broadcast(base), "file")
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/token_ids"
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    return token_index(spark, folder)
