"""Line dedup by an exact set-similarity join (DataFrame functions only).

A line's tokens are its distinct lower-cased words, ordered by rarity: by the
level of the corpus count of the word's hash bucket (a table of ``LEVELS``
buckets, bounded at any corpus size), then by hash.  A line goes if an earlier
one (by doc_id, then place), kept or not, has Jaccard similarity of at least
``SHARE`` percent.

1. Lines of equal token sets collapse to their earliest; the others go at once.
2. The earliest of each set gives its prefix, the ``n - ceil(SHARE n / 100) + 1``
   rarest tokens; two similar lines meet in a token of both prefixes.
3. Filters on a meeting: length, position (tokens still to come), and the
   parity, 64 bits (128 where both lines have over ``WIDE`` tokens) each flipped
   by the tokens that hash to it: lines that differ in d tokens differ in at most
   d bits.  All three lose nothing.
4. A token's list (ordered by place) of at most ``SHORT`` lines is met whole.  In a
   longer one each line first meets the list's first line and its ``NEAR``
   predecessors.  Only lines without such a candidate meet their whole list, and
   after verification also those whose candidates failed, so families of
   thousands of variants cost linear work and nothing is missed.
5. Candidates pass a parity of 256 more bits and are verified by the exact
   intersection of the token sets, made again from the lines' texts.

Defined results: a null text has no line; lines without words match nothing and
stay; a text's lines are cut at newline alone; rows repeated with id and text are
one document and are cut alike, rows of one id (or none) with different texts are
documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverylens.llm.common import documents, staged

SHARE, NEAR, SHORT, WIDE, LEVELS, MARKS = 80, 2, 256, 64, 65_536, 1 << 18
#: What ``\\s`` means besides a space; columns of a prefix entry.
WHITE, ENTRY = "\t\n\x0b\f\r", ["id", "n", "at", "parity", "odd"]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of the lines with a word, line_no from 0.  A document is told by its id
    and its text, as an id may be null or stand for several texts."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"\S"))


def words_in(line: Column) -> Column:
    """The lower-cased words, parted as ``\\s+`` parts them; cutting at one character needs no regular expression."""
    text = F.lower(line)
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def rarity_levels(docs: DataFrame) -> list[int]:
    """Level (0..126, coarse logarithm) of the number of words in each hash bucket."""
    words = docs.select(F.explode(words_in(F.col("text"))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(LEVELS - 1)).cast("int").alias("b")).count().collect()  # at most LEVELS rows
    out = [0] * LEVELS
    for r in counts:
        out[r.b] = min(126, int(4 * math.log2(r["count"] + 1)))
    return out


def ordered_tokens(line: Column, levels: list[int]) -> Column:
    """Token numbers, rarest first: the level above 56 bits of the word's hash."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")  # folded to one value

    def number(h: Column) -> Column:
        level = F.get(table, h.bitwiseAND(F.lit(LEVELS - 1)).cast("int"))
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.transform(words_in(line), lambda w: F.xxhash64(w))
    # sort_array is compiled; array_sort would call a comparison function per pair
    return F.sort_array(F.array_distinct(F.transform(hashes, number)))


def described(lines: DataFrame, levels: list[int]) -> DataFrame:
    """Adds toks, n, parity and, for a line of more than ``WIDE`` tokens, odd: the parity of its tokens of an odd seventh bit."""
    return (lines.withColumn("toks", ordered_tokens(F.col("line"), levels)).withColumn("n", F.size("toks"))
            .withColumn("parity", F.expr("aggregate(toks, 0L, (a, x) -> a ^ shiftleft(1L, cast(x & 63 as int)))"))
            .withColumn("odd", F.expr(f"if(n > {WIDE}, aggregate(toks, 0L, (a, x) -> if((x & 64) = 0, a, a ^ shiftleft(1L, cast(x & 63 as int)))), 0L)")))


def bits_allow(bits: Column, n: Column, m: Column, share: int) -> Column:
    """Whether similar sets of n and m tokens may differ in so many bits of a parity, hence tokens."""
    return (100 + share) * bits <= (100 - share) * (n + m)


def may_match(x: str, y: str, share: int) -> Column:
    """Length, position and parity filters on two entries (n, at, parity, odd)."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    bits, odd = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("parity", "odd"))
    both = F.bit_count(odd) + F.bit_count(bits.bitwiseXOR(odd))  # the parity by 128 bits
    most = 1 + F.least(n - F.col(f"{x}at"), m - F.col(f"{y}at")) + F.least(f"{x}at", f"{y}at")
    return (bits_allow(F.when(F.least(n, m) > WIDE, both).otherwise(F.bit_count(bits)), n, m, share)
            & (100 * F.least(n, m) >= share * F.greatest(n, m)) & ((100 + share) * most >= share * (n + m)))


def marked(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lines`` without those that are surely not in ``wanted`` (d, h, l), so that few texts move to the join: a table
    of 64 bits a word, at most ``MARKS`` words, has a bit for each line by the hash of its place."""
    def place(*cols: str) -> Column:
        return F.xxhash64(*cols)

    def word(h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(MARKS - 1))

    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    marks = (wanted.select(place("d", "h", "l").alias("place")).select(word(F.col("place")).alias("word"), bit.alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    placed = lines.withColumn("place", place("doc_id", "text_hash", "line_no"))
    return (placed.withColumn("word", word(F.col("place"))).join(F.broadcast(marks), "word")
            .where(F.col("bits").bitwiseAND(bit) != 0).select(*lines.columns))


def similar_pairs(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, levels: list[int], share: int) -> DataFrame:
    """The pairs (x, y: ids in ``firsts``) whose token sets are similar."""
    ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    wanted = staged(firsts.join(ids, "id").select("id", F.col("pos.doc_id").alias("d"), F.col("pos.text_hash").alias("h"),
                                                  F.col("pos.line_no").alias("l")), "wanted")
    lines = marked(lines_of(docs), wanted)
    sets = (lines.join(wanted, lines["doc_id"].eqNullSafe(wanted["d"]) & (lines["text_hash"] == wanted["h"]) & (lines["line_no"] == wanted["l"]))
            .select("id", ordered_tokens(F.col("line"), levels).alias("toks")))
    # a parity of four more words, by other bits of the tokens, leaves few pairs that carry their tokens
    wide = [F.expr(f"aggregate(toks, 0L, (a, x) -> if((x >> 6 & 3) = {k}, a ^ shiftleft(1L, cast(x >> 8 & 63 as int)), a))").alias(f"p{k}") for k in range(4)]
    sets = staged(sets.dropDuplicates(["id"]).select("id", "toks", F.size("toks").alias("n"), *wide), "verify_sets")

    def side(s: str, *cols: str) -> DataFrame:
        return sets.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}{c}") for c in cols])

    parts = ["n", *[f"p{k}" for k in range(4)]]
    bits = sum((F.bit_count(F.col(f"xp{k}").bitwiseXOR(F.col(f"yp{k}"))) for k in range(4)), F.lit(0))
    some = pairs.join(side("x", *parts), "x").join(side("y", *parts), "y").where(bits_allow(bits, F.col("xn"), F.col("yn"), share))
    some = staged(some.select("x", "y"), "close")
    both = some.join(side("x", "toks"), "x").join(side("y", "toks"), "y").withColumnsRenamed({"xtoks": "a", "ytoks": "b"})
    common = F.size(F.array_intersect("a", "b"))
    return both.where(100 * common >= share * (F.size("a") + F.size("b") - common)).select("x", "y")


def entries_of(firsts: DataFrame) -> DataFrame:
    """(id, n, parity, odd, at, token) of the tokens of each prefix."""
    return firsts.select("id", "n", "parity", "odd", F.posexplode("prefix").alias("at", "token")).where("token is not null")


def renamed(entries: DataFrame, side: str) -> DataFrame:
    return entries.select(F.col("token").alias(f"{side}token"), *[F.col(c).alias(f"{side}{c}") for c in ENTRY])


def met(x: DataFrame, entries: DataFrame, share: int) -> DataFrame:
    """(x, y): entries ``x`` with all earlier lines of their lists that pass the filters."""
    on = (F.col("xtoken") == F.col("ytoken")) & (F.col("yid") < F.col("xid")) & may_match("x", "y", share)
    return renamed(x, "x").join(renamed(entries, "y"), on).select(F.col("xid").alias("x"), F.col("yid").alias("y"))


def candidates(entries: DataFrame, share: int) -> DataFrame:
    """(x, y, near): in a list of at most ``SHORT`` lines all candidates; in a longer one a line's near candidates or,
    where it has none there, all.  Entries are dealt by token once, for all that is done with them."""
    dealt = entries.repartition("token")
    long = staged(dealt.groupBy("token").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > SHORT).select("token", F.lit(True).alias("long")), "long_lists")
    short = met(dealt.join(long, "token", "left").where("long is null"), dealt, share).withColumn("near", F.lit(False))
    if not long.limit(1).count():
        return short.groupBy("x", "y").agg(F.max("near").alias("near"))
    entries = dealt.join(long, "token").select("token", *ENTRY)
    place = W.partitionBy("token").orderBy("id")
    look = [("near0", lambda c: F.first(c).over(place))] + [(f"near{k}", lambda c, k=k: F.lag(c, k).over(place)) for k in range(1, NEAR + 1)]
    lists = entries.select("token", *[F.col(c).alias(f"x{c}") for c in ENTRY], *[at(c).alias(f"{name}{c}") for name, at in look for c in ENTRY])
    lists = lists.where("near1id is not null")
    tests = [F.coalesce((F.col(f"{name}id") < F.col("xid")) & may_match("x", name, share), F.lit(False)) for name, _ in look]
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    near = (lists.where(some).select(F.col("xid").alias("x"), F.explode(F.array(*[F.when(t, F.col(f"{name}id")) for t, (name, _) in zip(tests, look)])).alias("y"))
            .where("y is not null").withColumn("near", F.lit(True)))
    alone = lists.where(~some).select("token", *[F.col(f"x{c}").alias(c) for c in ENTRY])
    return (short.unionByName(near).unionByName(met(alone, entries, share).withColumn("near", F.lit(False)))
            .groupBy("x", "y").agg(F.max("near").alias("near")))


def later_matches(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, text_hash, line_no, equal): the lines to remove, of each document once; equal: whether an earlier
    line has the same tokens.  Documents are ordered by id and, where they share it, by their text's hash."""
    docs = docs.select("doc_id", "text")
    levels = rarity_levels(docs)
    prefix = F.expr(f"transform(slice(toks, 1, n - cast(ceil({share} * n / 100D) as int) + 1), x -> cast((x & 4294967295L) - 2147483648L as int))")
    # no filter on what is made from the tokens: it would be pushed below them and make them twice
    keys = (described(lines_of(docs), levels)
            .select(F.struct("doc_id", "text_hash", "line_no").alias("pos"), F.xxhash64("toks").alias("sid"), "n", "parity", "odd", prefix.alias("prefix")))
    keys = staged(keys, "line_keys")
    # sid and parity tell a set by 128 bits; ids follow the order of the sets' first lines
    firsts = keys.groupBy("sid", "parity", "n").agg(F.min("pos").alias("pos"), F.min("prefix").alias("prefix"), F.min("odd").alias("odd"), F.count(F.lit(1)).alias("copies"))
    firsts = staged(firsts.sort("pos").withColumn("id", F.monotonically_increasing_id()), "firsts")
    entries = entries_of(firsts)
    pairs = staged(candidates(entries, share), "candidates")
    good = staged(similar_pairs(pairs.select("x", "y"), firsts, docs, levels, share).select("x").distinct(), "similar")
    again = staged(pairs.where("near").select("x").distinct().join(good, "x", "left_anti").withColumnRenamed("x", "id"), "again")
    if again.limit(1).count():
        more = met(entries_of(firsts.join(again, "id", "left_semi")), entries, share).distinct()
        more = staged(more.join(pairs.select("x", "y"), ["x", "y"], "left_anti"), "more")
        if more.limit(1).count():
            good = staged(good.unionByName(similar_pairs(more, firsts, docs, levels, share).select("x")).distinct(), "similar")
    # a set goes from its first line on if that line has an earlier match, else from its second
    gone = staged(firsts.join(good.select(F.col("x").alias("id"), F.lit(True).alias("near")), "id", "left")
                  .where("copies > 1 or near").select("sid", "parity", "n", F.col("pos").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "gone")
    return (keys.select("pos", "sid", "parity", "n").join(gone, ["sid", "parity", "n"]).where((F.col("pos") != F.col("first")) | F.col("near"))
            .select("pos.doc_id", "pos.text_hash", "pos.line_no", (F.col("pos") != F.col("first")).alias("equal")).distinct())


def without_later_matches(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """``docs`` with those lines taken out of ``text``; all columns stay."""
    cut = staged(later_matches(docs, share).groupBy(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash")).agg(F.collect_set("line_no").alias("cut_lines")), "cut")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("cut_lines", i)), "\n")
    text = F.when(F.col("cut_lines").isNull(), F.col("text")).otherwise(kept)
    return (docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_hash")), "left")
            .select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns]))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return later_matches(documents(spark, sf_dir)).select("doc_id", "line_no", "equal").distinct()
