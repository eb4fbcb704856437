"""Spelling variants: words at edit distance one, found by pivotal grams.

Words are runs of Latin letters with A-Z lower-cased, counted over all documents in
each task first.  Two words are near when one inserted, deleted or replaced code
point turns one into the other.  Near pairs are found by their bigrams:

* all bigrams are ordered by how many words' places hold them, the rarest first,
* a word's *prefix* is its three rarest places (and all places that tie with the third),
* its *pivots* are two disjoint places of the prefix; dynamic programming along the
  word picks the pair that the fewest words' places share.

One edit spoils at most one of two disjoint bigrams.  So of two near words, the one
whose prefix ends no later in the order has a pivot which the other one's prefix holds
as well, at the same place or moved by the difference of their lengths.  Prefix places
are indexed by (bigram, place, length) and pivots look up the five keys that one edit
allows.  Each pair is looked for from one side only.  Candidates must have almost the
same letters (a 64-bit mask, at most two bits apart) and are then verified exactly.

Long index lists are cut: a key with more than LIST entries is dealt to several
parts, and each pivot that asks for it looks in all of them.  Only the bigrams' counts
reach the driver and every task; there are at most 65,536 of them, as a bigram outside
Latin-1 shares its number with others, which only adds candidates.

A word's *form* is its most frequent near word, where that one is at least twice as
frequent; its *root* follows the forms to the last.  Each step doubles the count, so
a chain is short; roots are found by pointer jumping.

Defined results: null texts hold no words; a null id counts as empty where it is
hashed; repeated rows count each; an empty table gives no rows; ties go to the
smallest word in code-point order; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deliverylens.llm.common import ByteTexts, documents, staged

#: Letters of a word as UTF-8 bytes, once A-Z are lower-cased: a-z and U+00C0 to U+00FF.
ASCII_RUN, LATIN_RUN = re.compile(rb"[a-z]+"), re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Distinct words that a task holds before it hands their counts on.
HELD = 1_000_000
#: Numbers that bigrams have; entries of an index key that stay together.
GRAMS, LIST = 65_536, 2_000
#: Edits allowed, and the rarest places that make a prefix of bigrams: 2 * edits + 1.
PREFIX = 3


def runs_of(text: bytes) -> list[bytes]:
    """The lower-cased runs of letters of a UTF-8 text."""
    low = text.lower()  # bytes: A-Z only
    return (ASCII_RUN if low.isascii() else LATIN_RUN).findall(low)


def with_deletions(doc_id, runs: list[bytes], every: int) -> Counter:
    """Counts of a document's runs; those whose crc32 with the id is divisible by ``every`` lose one code point."""
    counts = Counter(runs)
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    crc = zlib.crc32
    # all are taken out first: a result that is itself such a run has had its deletion
    for run, n in [(r, counts.pop(r)) for r in [r for r in counts if crc(r, seed) % every == 0]]:
        letters = run.decode()
        at = crc(run, seed) % len(letters)
        counts[(letters[:at] + letters[at + 1:]).encode()] += n
    return counts


def word_counts(docs: DataFrame, every: int = 97, min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the words that remain, over all rows of ``docs`` (doc_id, text)."""

    def run(batches):
        held: Counter = Counter()

        def handed():
            words = [w for w in held if len(w) >= min_letters]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), ByteTexts(batch.column("text"))
            for i, doc_id in enumerate(ids):
                runs = runs_of(texts[i])
                if not runs:
                    continue
                counts = with_deletions(doc_id, runs, every)
                for w, n in counts.items():
                    held[w] += n
                if len(held) > HELD:
                    yield from handed()
        yield from handed()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (found.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= min_count) & (F.char_length("word") >= min_letters)))


def by_length(words: list[str]):
    """(places in ``words``, code points as a matrix) for each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        joined = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(joined, "<u4").reshape(len(at), size)


def grams_of(codes: np.ndarray) -> np.ndarray:
    """Numbers of the bigrams at each place."""
    return ((codes[:, :-1].astype(np.int64) << 8) + codes[:, 1:]) % GRAMS


def gram_order(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bigram number how many places hold it and its rank, the rarest first."""

    def run(batches):
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            for _, codes in by_length(batch.column("word").to_pylist()):
                total += np.bincount(grams_of(codes).ravel(), minlength=GRAMS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    sums = words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(GRAMS, np.int64)
    for r in sums.collect():  # at most GRAMS rows
        counts[r.gram] = r.n
    rank = np.empty(GRAMS, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(GRAMS, dtype=np.int32)
    return counts, rank


def cheapest_pair(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places i < j, j - i >= 2, whose costs have the least sum.

    Dynamic programming along the places: the best single place so far, and the best pair that ends here."""
    n, places = cost.shape
    one, one_at = cost[:, 0].copy(), np.zeros(n, np.int32)
    best = np.full(n, np.inf)
    first, second = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for j in range(2, places):
        here = one + cost[:, j]
        better = here < best
        best[better] = here[better]
        first[better], second[better] = one_at[better], j
        nearer = cost[:, j - 1] < one
        one[nearer], one_at[nearer] = cost[nearer, j - 1], j - 1
    return first, second


def signatures(codes: np.ndarray, counts: np.ndarray, rank: np.ndarray):
    """(row, place, gram, is pivot) of all prefix places, each row's last rank, and the letters' masks."""
    grams = grams_of(codes)
    if grams.shape[1] < PREFIX:
        raise ValueError(f"words need {PREFIX + 1} letters at least")
    ranks = rank[grams]
    last = np.partition(ranks, PREFIX - 1, axis=1)[:, PREFIX - 1]
    inside = ranks <= last[:, None]
    first, second = cheapest_pair(np.where(inside, counts[grams].astype(np.float64), np.inf))
    row, place = np.nonzero(inside)
    pivot = (place == first[row]) | (place == second[row])
    mask = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        mask |= np.uint64(1) << (column % 64).astype(np.uint64)
    return row, place, grams[row, place], pivot, last, mask


def indexed(words: DataFrame, counts: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Prefix places: (gram, place, size, last, mask, pivot, word)."""
    shared = words.sparkSession.sparkContext.broadcast((counts, rank))  # two arrays of GRAMS numbers

    def run(batches):
        n_of, rank_of = shared.value
        for batch in batches:
            column = batch.column("word")
            for at, codes in by_length(column.to_pylist()):
                row, place, gram, pivot, last, mask = signatures(codes, n_of, rank_of)
                size = np.full(len(row), codes.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(size), pa.array(last[row].astype(np.int32)),
                     pa.array(mask[row].view(np.int64)), pa.array(pivot), column.take(pa.array(at[row]))],
                    names=["gram", "place", "size", "last", "mask", "pivot", "word"])

    return words.select("word").mapInArrow(run, "gram int, place int, size int, last int, mask long, pivot boolean, word string")


#: What one edit does to an unspoilt bigram: (change of its place, change of the word's length).
MOVES = ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))


def one_edit_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all pairs of distinct near words of ``words`` (word), once each."""
    counts, rank = gram_order(words)
    places = staged(indexed(words, counts, rank), "prefix_places")
    key = ["gram", "place", "size"]
    long_lists = places.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LIST)
    long_lists = staged(long_lists.select(*key, F.ceil(F.col("n") / LIST).cast("int").alias("parts")), "long_lists")

    def dealt(entries: DataFrame) -> DataFrame:
        return entries.join(long_lists, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    lists = dealt(places).select(*key, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), F.col("last").alias("last_b"),
                                 F.col("mask").alias("mask_b"), F.col("word").alias("b"))
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(e).alias("e")) for d, e in MOVES])).alias("m")
    asked = (places.where("pivot").select("*", moves)
             .select("gram", (F.col("place") + F.col("m.d")).alias("place"), (F.col("size") + F.col("m.e")).alias("size"),
                     F.col("last").alias("last_a"), F.col("mask").alias("mask_a"), F.col("word").alias("a")))
    asked = dealt(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = lists.join(asked, [*key, "part"])
    side = (F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b")))
    alike = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    return met.where(side & alike & one_edit_apart(F.col("a"), F.col("b"))).select("a", "b").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form; form not null): the end of each word's chain, by pointer jumping."""
    links = staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    for _ in range(64):  # a chain doubles the count at each step, so it has fewer than 64; each round doubles the reach
        up = links.select(F.col("word").alias("root"), F.col("root").alias("up"))
        links = staged(links.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
    raise RuntimeError("a chain of forms does not end")


def spelling_variants(words: DataFrame) -> DataFrame:
    """One row for each row of ``words`` (word, n; words distinct, four letters at least): word, form, root, n, n_near, form_n."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")
    named = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = named.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    taken = F.col("best.less") * -1 >= 2 * F.col("n")
    found = staged(words.join(best, "word", "left")
                   .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                           F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "forms")
    roots = roots_of(found.where("form is not null"))
    return (found.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    words = staged(word_counts(documents(spark, sf_dir)), "words")
    return spelling_variants(words)
