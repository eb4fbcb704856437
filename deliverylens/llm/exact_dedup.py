"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks at places that its own content defines (the end of a
sentence or line once a chunk has ``MIN_CHUNK`` characters, at the latest after
``MAX_CHUNK``).  A chunk's identifier is its 64-bit hash, *verified* over the
whole table: distinct (hash, chunk) pairs are formed, comparing the bytes, and
every hash that stands for two different chunks is set aside; such a chunk is
identified by its own content instead.  Two texts are equal exactly when their
ordered lists of verified identifiers (their recipes) are equal, so that the
text itself moves once, as chunks that each map task has already made distinct,
and grouping and comparing handle short lists only.

Of each group exactly one row stays: one with the largest doc_id and, among rows
that tie on it, the one read last.

Defined results: a null text counts as empty; empty texts are equal; of rows
repeated with the same doc_id one stays; a null doc_id is less than any other, and
of a group of null ids only one row stays, with a null keep_id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverylens.llm.common import id_text, staged

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Hashes that stand for several chunks: with 64 bits a few hundred are expected
#: in 100 TB.  Beyond this many the hash is broken, and the job says so.
MAX_COLLISIONS = 100_000


def chunks_of(text: Column) -> Column:
    """The text's chunks, in order; joined they give the text again."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?\n,;:]\s?)|(?s).{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def collided_hashes(chunked: DataFrame, chunk_hash: Callable[[Column], Column]) -> list[int]:
    """Hashes that stand for more than one chunk content in the whole table."""
    pairs = (chunked.select(F.explode("chunks").alias("chunk"))
             .select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct())
    bad = pairs.groupBy("h").count().where("count > 1").select("h").limit(MAX_COLLISIONS + 1).collect()
    if len(bad) > MAX_COLLISIONS:
        raise ValueError("the chunk hash gives too many collisions")
    return [r.h for r in bad]


def recipe_of(chunks: Column, bad: list[int], chunk_hash: Callable[[Column], Column]) -> Column:
    """Ordered list of verified identifiers."""
    if not bad:
        return F.transform(chunks, lambda c: chunk_hash(c))
    known = F.array(*[F.lit(x).cast("long") for x in bad])
    return F.transform(chunks, lambda c: F.when(F.array_contains(known, chunk_hash(c)), F.concat(F.lit("="), c))
                       .otherwise(chunk_hash(c).cast("string")))


def exact_groups(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest doc_id stays."""
    base = id_text(docs)
    cut = base.select("doc_id", "text", chunks_of(F.col("text")).alias("chunks"))
    bad = collided_hashes(cut, chunk_hash)
    recipes = staged(cut.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                                F.size("chunks").cast("long").alias("n_chunks"),
                                recipe_of(F.col("chunks"), bad, chunk_hash).alias("recipe"),
                                F.monotonically_increasing_id().alias("row")), "recipes")
    groups = (recipes.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1"))
    # written first: the join then has plain exchanges on both sides, whose hot partitions are split at run time
    groups = staged(groups.select("recipe", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row"), "group_size"), "groups")
    alone = F.col("group_size").isNull()
    return (recipes.join(groups, "recipe", "left")
            .select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "n_chunks"))


def one_row_each(docs: DataFrame, key: list[Column], pairs: DataFrame) -> DataFrame:
    """``docs`` with, of the rows of each ``pairs`` (p0, p1: an id and a digest of its text, both as given by
    ``key``), one row only; all other rows as they are.

    Rows of one pair have one id and one text, so they may differ in other columns only; the one with the
    smallest hash of all columns stays.  It is found by a grouped minimum, partial in each task."""
    same = key[0].eqNullSafe(pairs["p0"]) & (key[1] == pairs["p1"])
    row = F.struct(*[docs[c] for c in docs.columns])
    tied = docs.join(pairs, same, "left_semi").select(key[0].alias("p0"), key[1].alias("p1"), row.alias("row"), F.xxhash64(F.to_json(row)).alias("h"))
    one = tied.groupBy("p0", "p1").agg(F.min_by("row", "h").alias("row")).select("row.*")
    return docs.join(pairs, same, "left_anti").unionByName(one)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, all columns as they were."""
    found = exact_groups(docs).where("group_size > 1")
    # by id and text: an id may be null or stand for several texts
    pairs = staged(found.groupBy(F.col("doc_id").alias("p0"), F.col("text_sha256").alias("p1"))
                   .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "pairs")
    key = [docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)]
    gone = pairs.where("not stays")
    left = docs.join(gone, key[0].eqNullSafe(gone["p0"]) & (key[1] == gone["p1"]), "left_anti")
    ties = pairs.where("stays and n > 1").select("p0", "p1")
    if not ties.limit(1).count():
        return left
    key = [left["doc_id"].cast("long"), F.sha2(F.coalesce(left["text"], F.lit("")).cast("binary"), 256)]
    return one_row_each(left, key, ties)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from deliverylens.llm.common import documents
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {"op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""}
