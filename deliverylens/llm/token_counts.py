"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content together with a digest of
the tokenizer (its file's bytes, the library and its version).  The cache is a
Parquet table of (content digest, n_tokens) with a folder for each tokenizer
digest.  A call joins the documents' digests to it, encodes only the distinct
contents that it does not hold, appends their counts and joins again:

1. each document becomes (doc_id, n_bytes, digest); texts stay where they are,
2. digests are grouped; for each one that the cache lacks, one row is its *owner*,
3. the owners' texts are fetched by a semi join on (digest, doc_id) and encoded,
4. the new counts are appended, in one Spark write, and all documents look theirs up.

Only short rows are ever grouped, with partial sums in each map task, so a content
that a third of all rows share is one row after the map side and one text in step 3.
In step 4 the contents that hold at least 1/HOT of the rows (hence at most HOT of
them) are looked up by a broadcast join, the others by a shuffle.

Normalised content: where the tokenizer drops white space and never joins across it
(checked on its file), runs of ASCII white space count as one space and leading and
trailing ones as none; otherwise the text as it is.  Either way equal contents have
equal counts.  Two writers may append one content twice; readers group by digest.
An append that fails leaves no rows, and a call that is run again finds what earlier
calls stored.

Defined results: a null text counts as empty, with 0 bytes; repeated rows, ids that
stand for several texts and null ids are counted each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deliverylens.llm.common import ByteTexts, documents, id_text, slices, staged
from deliverylens.session import checkpoint_dir

#: Words whose counts a worker remembers.
WORDS = 600_000
#: Digests of which a task remembers that it has encoded their text.
DONE = 500_000
#: A content with at least this part of all rows is looked up by a broadcast join.
HOT = 256
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def parts_at_space(path: str) -> bool:
    """Whether the tokenizer file drops white space and cuts there, so that words can be counted one by one.

    True for a file whose normaliser turns white space into one space, whose pre-tokenizer
    keeps only the matches of a pattern of non-space characters, and whose special
    strings hold no space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    listed = lambda part, key: (part or {}).get(key) or ([part] if part else [])
    normal = listed(config.get("normalizer"), "normalizers")
    first = (listed(config.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "") if first.get("type") == "Split" else ""
    kept = first.get("behavior") == "Removed" and first.get("invert") is True
    # each alternative is a contraction, a class of letters, one number, or anything but space, letters and numbers
    spaceless = bool(pattern) and all(a in (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or (a.startswith("'") and a[1:].isalpha())
                                      for a in pattern.split("|"))
    known = all(n.get("type") in ("NFC", "Lowercase") or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ")
                for n in normal)
    special = all(not any(c.isspace() for c in t["content"]) for t in config.get("added_tokens", []))
    return kept and spaceless and known and special and (config.get("model") or {}).get("dropout") is None


class TokenCounter:
    """Token counts of whole texts as the library gives them, without begin, end or padding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_word = parts_at_space(path)
        self.known: dict[bytes, int] = {}
        self.closing = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.pieces = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            suffix = (json.load(f).get("model") or {}).get("end_of_word_suffix")
        if self.by_word and suffix:
            # a run of letters is one unit, and exactly its last token ends with the suffix
            self.closing = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.closing[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def __call__(self, texts: list[bytes]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode([t.decode() for t in texts], num_threads=1)]
        if not self.by_word:
            return self._whole(texts)
        known = self.known
        if len(known) > WORDS:
            known.clear()
        split = [t.split() for t in texts]  # at the six ASCII white-space bytes
        new = list(set(chain.from_iterable(split)).difference(known))
        if new:
            self._learn(new)
        return [sum(map(known.__getitem__, words)) for words in split]

    def _learn(self, new: list[bytes]) -> None:
        letters = [w for w in new if w.isalpha()] if self.closing is not None else []  # ASCII letters only
        if letters:
            coded = self.tokenizer.encode_batch_fast([b" ".join(letters).decode()], add_special_tokens=False)[0]
            ends = np.flatnonzero(self.closing[np.array(coded.ids)])
            if len(ends) == len(letters):
                self.known.update(zip(letters, np.diff(ends, prepend=-1).tolist()))
            else:
                letters = []
        rest = [w for w in new if w not in self.known] if letters else new
        self.known.update(zip(rest, self._whole(rest)))

    def _whole(self, texts: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def content_digest(text: Column, path: str) -> Column:
    content = F.trim(F.regexp_replace(text, ASCII_SPACE, " ")) if parts_at_space(path) else text
    return F.unhex(F.sha2(content.cast("binary"), 256))


def counted(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows, one row for each digest."""

    def run(batches):
        count, done = counter(path), set()
        for batch in batches:
            digests, column = batch.column("digest").to_pylist(), batch.column("text")
            raw = ByteTexts(column)
            for lo, hi in slices(column):
                if len(done) > DONE:
                    done.clear()
                new = {digests[i]: i for i in range(lo, hi) if digests[i] not in done}  # a row may be repeated
                done.update(new)
                n = count([raw[i] for i in new.values()])
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return (texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
            .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))


class CountCache:
    """The stored counts of one tokenizer: a folder of Parquet files that only grows."""

    SCHEMA = "digest binary, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.path = spark, f"{folder}/tokenizer={tokenizer}"
        self.append(spark.createDataFrame([], self.SCHEMA))  # makes the folder

    def rows(self) -> DataFrame:
        """One row for each content; equal contents have equal counts."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "n_tokens").write.mode("append").parquet(self.path)


def token_counts(docs: DataFrame, path: str, cache_folder: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, digest, cached (found in the cache as it was)."""
    spark = docs.sparkSession
    cache = CountCache(spark, cache_folder, tokenizer_digest(path))
    texts = id_text(docs).withColumn("digest", content_digest(F.col("text"), path))
    keyed = staged(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    groups = keyed.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    before = cache.rows().select(F.col("digest").alias("digest"), F.lit(True).alias("cached"))
    groups = staged(groups.join(before, "digest", "left").select("digest", "owner", "n", F.coalesce("cached", F.lit(False)).alias("cached")), "contents")

    misses = groups.where("not cached").select(F.col("digest").alias("miss"), "owner")
    owned = texts.join(misses, (texts["digest"] == misses["miss"]) & texts["doc_id"].eqNullSafe(misses["owner"]), "left_semi")
    cache.append(counted(owned, path))

    counts = groups.join(cache.rows(), "digest").select(F.col("digest").alias("key"), "n", "n_tokens", "cached")
    counts = staged(counts, "counts")
    rows = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT >= rows
    hot = F.broadcast(counts.where(is_hot).select("key", "n_tokens", "cached"))  # at most HOT rows
    rest = counts.where(~is_hot).select("key", "n_tokens", "cached")
    looked = keyed.join(hot, keyed["digest"] == hot["key"], "left").drop("key")
    mine = looked.where("n_tokens is null").drop("n_tokens", "cached")
    cold = mine.join(rest, mine["digest"] == rest["key"]).drop("key")
    columns = ["doc_id", "n_bytes", "n_tokens", "digest", "cached"]
    return looked.where("n_tokens is not null").select(columns).unionByName(cold.select(columns))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents.  The query starts with a cache of its own that is empty, so that its result
    and its work don't depend on earlier runs; :func:`token_counts` takes a folder that is kept."""
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/token_count_cache"
    out = token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
