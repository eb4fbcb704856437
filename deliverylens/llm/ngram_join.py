"""N-gram Jaccard join with multiple global orders.

A document's set holds its distinct word shingles (as 64-bit hashes).  Documents
link when 100 * |A & B| >= 85 * |A | B|.  So a document of n shingles can miss at
most ``miss(n) = n - ceil(85 n / 100)`` of them in a partner, and the prefixes of
``miss + 1`` shingles of two linked documents meet under *every* global order.

1. Documents of equal sets collapse to one node (a verified 64-bit signature).
2. A third of the shingle space (by hash) is dealt to buckets and counted.  A
   node must find all but ``miss`` of its shingles there in other nodes; most
   documents end here, without loss.
3. The others' whole sets are dealt and counted.  Orders put shingles of one
   node first, then by rarity (first order) or by a hash (further orders); a
   node keeps the shingles of its prefixes that some other node has.
4. Nodes that share a prefix shingle under the first order form clusters, which
   are cut into blocks of ``BLOCK`` nodes.  In a block, a pair must pass the
   length filter and share prefix shingles under all ``ORDERS`` orders before its
   overlap is counted exactly on bit rows.  Nodes already joined are not compared
   again.  For clusters of several blocks each block also holds the cluster's
   first ``PIVOTS`` nodes; then the nodes outside the cluster's largest group
   meet all its blocks, so no pair of different groups is left unseen and a huge
   group of near copies costs linear work.
5. Components of the links give the smallest doc_id of each class.

Defined results: a null or empty text has no shingles and links with nothing;
fewer words than a shingle make one shingle of them all; repeated rows are equal
sets; rows with a null doc_id take part, but never name a component unless all
are null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverylens.llm.common import (ByteTexts, WordHash, components, documents, id_text, mix64, partitions,
                                     shingle_hashes, staged, words_of)
from deliverylens.llm.exact_dedup import one_row_each

SHINGLE, SHARE = 4, 85
#: Shingle space that the first count looks at: one in SPACE.
SPACE = 3
ORDERS, BLOCK, PIVOTS = 3, 128, 16
#: Entries of a bucket and shingles of a block, about.
BUCKET_ENTRIES, BLOCK_SHINGLES = 1_000_000, 2_000_000
#: Signature clashes that the driver may hold (64 bits: about a hundred in 100 TB).
MAX_CLASHES = 100_000


def miss_of(n, share: int = SHARE):
    """Shingles of a document of n that a linked one may lack."""
    return n - (share * n + 99) // 100


def set_of(hashes: WordHash, text: bytes, k: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(hashes(words_of(text)), k))


def signatures(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    both = np.array([xxhash.xxh3_64_intdigest(raw), xxhash.xxh3_64_intdigest(raw, seed=0x5EED)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def described(docs: DataFrame, k: int, hashed: bool = False) -> DataFrame:
    """(doc_id, n, n_sub, sig, sig2) of each row; with ``hashed`` the text's hash too."""
    extra = ["text_hash"] if hashed else []

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            raw, rows = ByteTexts(batch.column(1)), []
            for i in range(batch.num_rows):
                s = set_of(hashes, raw[i], k)
                rows.append((len(s), int((s % np.uint64(SPACE) == 0).sum()), *signatures(s)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols),
                                              *(batch.column(2 + i) for i in range(len(extra)))],
                                             names=["doc_id", "n", "n_sub", "sig", "sig2", *extra])

    rows = id_text(docs).select("doc_id", "text", *[F.xxhash64("text").alias(x) for x in extra])
    return rows.mapInArrow(run, "doc_id long, n long, n_sub long, sig long, sig2 long" + "".join(f", {x} long" for x in extra))


def deal(docs: DataFrame, k: int, buckets: int, clashes: frozenset, space: int) -> DataFrame:
    """(bucket, shingles, nodes, sizes): the shingles of each set in one of ``space`` parts of the hash space,
    by bucket, each with its node and the size of the node's whole set."""

    def run(batches):
        hashes, seen, sets, nodes, sizes, held = WordHash(), set(), [], [], [], 0

        def flush():
            s, n = np.concatenate(sets), [len(x) for x in sets]
            order = np.argsort(s, kind="stable")
            s, who = s[order], np.repeat(np.array(nodes, np.int64), n)[order]
            whole = np.repeat(np.array(sizes, np.uint32), n)[order]
            return blobs(bucket_of(s, buckets), [s, who, whole], ["shingles", "nodes", "sizes"])

        for batch in batches:
            raw = ByteTexts(batch.column(0))
            for i in range(batch.num_rows):
                s = set_of(hashes, raw[i], k)
                if not len(s):
                    continue
                one, two = signatures(s)
                node = two if one in clashes else one
                if node in seen:
                    continue
                seen.add(node)
                sizes.append(len(s))
                s = s[s % np.uint64(space) == 0] if space > 1 else s
                sets.append(s)
                nodes.append(node)
                held += len(s)
                if held > 600_000:
                    yield flush()
                    sets, nodes, sizes, held = [], [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, shingles binary, nodes binary, sizes binary")


def blobs(bucket: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket (sorted) with its slices of the arrays."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    stop = np.append(first[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first], pa.int32()), *(pa.array([x[lo:hi].tobytes() for lo, hi in zip(first, stop)], pa.binary()) for x in arrays)],
        names=["bucket", *names])


def in_buckets(rows: DataFrame, buckets: int, kinds: dict[str, type], each, schema: str) -> DataFrame:
    """``each`` on every bucket's arrays, joined from its rows; it returns a frame or None."""

    def run(batches):
        at, held = None, []

        def done():
            return each(*(np.concatenate([np.frombuffer(r[i], kind) for r in held]) for i, kind in enumerate(kinds.values())))

        for pdf in batches:
            for b, *x in zip(pdf["bucket"], *(pdf[c] for c in kinds)):
                if at is not None and b != at:
                    if (out := done()) is not None:
                        yield out
                    held = []
                at = b
                held.append(x)
        if at is not None and (out := done()) is not None:
            yield out

    parts = min(buckets, max(partitions(rows.sparkSession), buckets // 4))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


DEALT = {"shingles": np.uint64, "nodes": np.int64, "sizes": np.uint32}


def shared_entries(a: np.ndarray, b: np.ndarray, n: np.ndarray):
    """Distinct (shingle, node, size) entries whose shingle has several nodes, and the number of these."""
    order = np.argsort(a, kind="stable")
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.diff(a, prepend=~a[:1]) != 0)
    times = np.diff(np.append(first, len(a)))
    many = np.repeat(times > 1, times)
    a, b, n = a[many], b[many], n[many]
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, n = a[new], b[new], n[new]
    if not len(a):
        return a, b, n, np.zeros(0, np.uint32)
    first = np.flatnonzero(np.diff(a, prepend=~a[:1]) != 0)
    times = np.diff(np.append(first, len(a)))
    df = np.repeat(times, times)
    return a[df > 1], b[df > 1], n[df > 1], df[df > 1].astype(np.uint32)


def dealt_back(node: np.ndarray, arrays: list[np.ndarray], names: list[str], buckets: int) -> pd.DataFrame | None:
    """Rows of the nodes' own buckets."""
    if not len(node):
        return None
    to = bucket_of(mix64(node.view(np.uint64)), buckets)
    order = np.argsort(to, kind="stable")
    return blobs(to[order], [x[order] for x in (node, *arrays)], ["nodes", *names]).to_pandas()


def shared_counts(dealt: DataFrame, buckets: int) -> DataFrame:
    """(node, shared): how many of its dealt shingles each node shares with another."""

    def count(a, b, n):
        _, node, _, _ = shared_entries(a, b, n)
        node, times = np.unique(node, return_counts=True)
        return dealt_back(node, [times.astype(np.int64)], ["times"], buckets)

    def add(node, times):
        names, inv = np.unique(node, return_inverse=True)
        return pd.DataFrame({"node": names, "shared": np.bincount(inv, times).astype(np.int64)})

    back = in_buckets(dealt, buckets, DEALT, count, "bucket int, nodes binary, times binary")
    return in_buckets(back, buckets, {"nodes": np.int64, "times": np.int64}, add, "node long, shared long")


def active_nodes(dealt: DataFrame, buckets: int, share: int) -> DataFrame:
    """(node, n, shingles, prefix) of the nodes whose prefix holds a shingle of another node; shingles: those shared."""

    def shared(a, b, n):
        a, b, n, df = shared_entries(a, b, n)
        return dealt_back(b, [a, df, n], ["shingles", "df", "sizes"], buckets)

    def choose(node, a, df, n):
        order = np.lexsort((a, df, node))  # rarest first
        node, a, n = node[order], a[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.diff(node, prepend=~node[:1]) != 0)
        stop = np.append(first[1:], len(node))
        take = miss_of(n[first], share) + 1 - (n[first] - (stop - first))  # shingles of one node come first
        rows = [(node[lo], n[lo], np.sort(a[lo:hi]).tobytes(), a[lo:lo + t].tobytes())
                for lo, hi, t in zip(first, stop, take) if t > 0]
        return pd.DataFrame(rows, columns=["node", "n", "shingles", "prefix"]) if rows else None

    back = in_buckets(dealt, buckets, DEALT, shared, "bucket int, nodes binary, shingles binary, df binary, sizes binary")
    return in_buckets(back, buckets, {"nodes": np.int64, "shingles": np.uint64, "df": np.uint32, "sizes": np.uint32}, choose,
                      "node long, n long, shingles binary, prefix binary")


def links_in(n: np.ndarray, shingles: list[np.ndarray], prefix: list[np.ndarray], group: np.ndarray,
             left: np.ndarray, right: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links that join different groups, between members marked ``left`` and members marked ``right``."""
    m = len(n)
    names, inv, df = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    live = np.flatnonzero(df > 1)
    number = np.full(len(names), -1)
    number[live] = np.arange(len(live))
    edges = np.cumsum([0, *map(len, shingles)])

    def bits(ids: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((m, (len(live) + 63) // 64 * 8), np.uint8)
        row = np.zeros(out.shape[1] * 8, np.uint8)
        for i, x in enumerate(ids):
            x = x[x >= 0]
            row[x] = 1
            out[i] = np.packbits(row)
            row[x] = 0
        return out.view(np.uint64)

    if not len(live):
        return []
    own = [number[inv[edges[i]:edges[i + 1]]] for i in range(m)]
    whole = bits(own)
    fronts = [bits([number[np.searchsorted(names, p)] for p in prefix])]
    for k in range(1, ORDERS):
        rank = mix64(names ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF))
        part = []
        for i in range(m):
            mine = inv[edges[i]:edges[i + 1]]
            part.append(number[mine[np.argsort(rank[mine], kind="stable")[:len(prefix[i])]]])
        fronts.append(bits(part))
    group = group.copy()
    found = []
    for i in range(m):
        at = np.arange(m) > i
        at &= ((left[i] & right) | (right[i] & left)) & (group != group[i])
        at &= length_ok(n[i], n, share)
        j = np.flatnonzero(at)
        for front in fronts:
            if not len(j):
                break
            j = j[(front[i] & front[j]).any(1)]
        if not len(j):
            continue
        both = np.bitwise_count(whole[i] & whole[j]).sum(1).astype(np.int64)
        for x in j[100 * both >= share * (n[i] + n[j] - both)]:
            if group[x] != group[i]:
                found.append((i, int(x)))
                group[group == group[x]] = group[i]
    return found


def length_ok(a, b, share):
    """Length filter."""
    return 100 * np.minimum(a, b) >= share * np.maximum(a, b)


def linked(blocks: DataFrame, share: int) -> DataFrame:
    """Links (a, b) of each (cluster, i, j) block; columns node, n, shingles, prefix, grp, side (1 left, 2 right, 3 both)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "node", "side"]).groupby("node", sort=False, as_index=False).agg(
            {"n": "first", "shingles": "first", "prefix": "first", "grp": "first", "side": lambda x: int(np.bitwise_or.reduce(x))})
        if len(pdf) < 2:
            return pd.DataFrame({"a": [], "b": []})
        node, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
        got = links_in(pdf["n"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]],
                       [np.frombuffer(x, np.uint64) for x in pdf["prefix"]], pdf["grp"].to_numpy(),
                       side & 1 > 0, side & 2 > 0, share)
        return pd.DataFrame({"a": [node[x] for x, _ in got], "b": [node[y] for _, y in got]}, dtype=np.int64)

    return blocks.groupBy("cluster", "i", "j").applyInPandas(run, "a long, b long")


def prefix_edges(active: DataFrame) -> DataFrame:
    """(a, b): each node and the smallest node that shares a prefix shingle with it."""

    def run(batches):
        for batch in batches:
            s = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if s:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(s)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in s]))],
                    names=["shingle", "node"])

    entries = staged(active.select("node", "prefix").mapInArrow(run, "shingle long, node long"), "prefixes")
    lead = staged(entries.groupBy("shingle").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c"))
                  .where("c > 1").select("shingle", "b"), "leads")
    return entries.join(lead, "shingle").select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def all_links(active: DataFrame, share: int) -> DataFrame:
    """Enough links (a, b) of the active nodes to join every pair of linked ones."""
    clusters = staged(components(prefix_edges(active)), "clusters")
    members = staged(active.join(clusters, "node").withColumnRenamed("component", "cluster")
                     .withColumn("size", (F.octet_length("shingles") / 8).cast("long")), "members")
    sizes = (members.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("total"))
             .select("cluster", F.greatest(F.ceil(F.col("docs") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).alias("blocks")))
    sizes = staged(sizes, "sizes")
    members = members.drop("size")
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "cluster").withColumn("i", place)
    zero = F.lit(0).cast("int")
    first = dealt.select("cluster", "i", zero.alias("j"), "node", "n", "shingles", "prefix", F.col("node").alias("grp"), F.lit(3).alias("side"))
    # the first nodes of a cluster of several blocks stand in each of its blocks
    rank = F.row_number().over(W.partitionBy("cluster").orderBy("node"))
    several = sizes.where("blocks > 1").withColumnRenamed("cluster", "big")
    pivots = (members.join(several, F.col("cluster") == F.col("big")).withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
              .withColumn("i", F.explode(F.sequence(zero, (F.col("blocks") - 1).cast("int"))))
              .select("cluster", "i", zero.alias("j"), "node", "n", "shingles", "prefix", F.col("node").alias("grp"), F.lit(3).alias("side")))
    links = staged(linked(first.unionByName(pivots), share), "links")
    if not several.limit(1).count():
        return links
    # nodes outside the largest group of their cluster meet all blocks
    groups = components(links)
    grouped = staged(members.join(several, F.col("cluster") == F.col("big")).drop("big").join(groups, "node", "left")
                     .withColumn("grp", F.coalesce("component", "node")).drop("component"), "grouped")
    counts = grouped.groupBy("cluster", "grp").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("c", "grp")).alias("top"), F.sum("c").alias("docs"))
    largest = staged(largest.select("cluster", F.col("top.grp").alias("top"),
                                    F.ceil((F.col("docs") - F.col("top.c")) / BLOCK).cast("int").alias("rest")), "largest")
    grouped = grouped.join(largest, "cluster").where("rest > 0")
    cols = ["cluster", "i", "j", "node", "n", "shingles", "prefix", "grp", "side"]
    others = (grouped.where(F.col("grp") != F.col("top"))
              .withColumn("i", F.pmod(F.xxhash64("node"), F.col("rest")).cast("int"))
              .withColumn("j", F.explode(F.sequence(zero, (F.col("blocks") - 1).cast("int"))))
              .withColumn("side", F.lit(1)).select(*cols))
    everyone = (grouped.withColumn("j", place).withColumn("i", F.explode(F.sequence(zero, F.col("rest") - 1)))
                .withColumn("side", F.lit(2)).select(*cols))
    return staged(links.unionByName(linked(others.unionByName(everyone), share)), "all_links")


def near_groups(docs: DataFrame, k: int = SHINGLE, share: int = SHARE, hashed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id; with ``hashed`` also text_hash and
    ``grp``, which tells groups apart even where all their ids are null (null: no shingles)."""
    extra = ["text_hash"] if hashed else []
    spark = docs.sparkSession
    desc = staged(described(docs, k, hashed), "described")
    clash = (desc.groupBy("sig").agg(F.min("sig2").alias("lo"), F.max("sig2").alias("hi")).where("lo <> hi")
             .select("sig").limit(MAX_CLASHES + 1).collect())
    if len(clash) > MAX_CLASHES:
        raise ValueError("the signature gives too many clashes")
    clashes = frozenset(r.sig for r in clash)
    node = F.when(F.col("sig").isin(list(clashes)), F.col("sig2")).otherwise(F.col("sig")) if clashes else F.col("sig")
    desc = desc.select("doc_id", "n", "n_sub", node.alias("node"), *extra)
    nodes = staged(desc.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"),
                                                          F.max("n_sub").alias("n_sub"), F.count(F.lit(1)).alias("copies")), "nodes")
    total = nodes.agg(F.sum("n_sub")).first()[0] or 0
    buckets = max(2 * partitions(spark), int(total // BUCKET_ENTRIES) + 1)
    base = id_text(docs)
    shared = shared_counts(deal(base, k, buckets, clashes, SPACE), buckets)
    miss = F.col("n") - F.floor((F.lit(share) * F.col("n") + 99) / 100)
    alive = staged(nodes.join(shared, "node", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("n_sub") - miss)
                   .select("node", "n", F.col("rep").alias("rep_id")), "alive")
    total = alive.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * partitions(spark), int(total // BUCKET_ENTRIES) + 1)
    # by a shuffle at every size: the list of what is left grows with the documents
    kept = base.join(alive.select("rep_id").hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi")
    active = staged(active_nodes(deal(kept, k, buckets, clashes, 1), buckets, share), "active")
    joined = components(all_links(active, share))
    named = nodes.select("node", "rep", "copies").join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
    ids = named.where("component is not null").groupBy("label").agg(F.min("rep").alias("component_id"))
    # only nodes of several documents need an answer other than their own id
    answer = staged(named.join(ids, "label", "left").select("node", "label", F.coalesce("component_id", "rep").alias("component_id"), "copies", "component")
                    .where("copies > 1 or component is not null").select("node", "label", "component_id"), "answers")
    grp = [F.when(desc["n"] > 0, F.coalesce(answer["label"], desc["node"])).alias("grp")] if hashed else []
    return (desc.join(answer, (desc["node"] == answer["node"]) & (desc["n"] > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *extra, *grp))


def one_of_each(docs: DataFrame, k: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One document of each group, that with the smallest doc_id, columns as they were.

    Of rows that share this id, that of the smallest text hash stays and, where the text is the same too, one row
    of them; a null id comes last.  A document without shingles is a group of its own."""
    # by id and text: an id may be null or stand for several texts
    pairs = staged(near_groups(docs, k, share, hashed=True).where("grp is not null")
                   .groupBy("grp", F.col("doc_id").alias("p0"), F.col("text_hash").alias("p1")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    first = staged(pairs.groupBy(F.col("grp").alias("g"))
                   .agg(F.min(F.struct(F.col("p0").isNull().alias("no_id"), "p0", "p1")).alias("stays"), F.sum("n").alias("rows"))
                   .where("rows > 1").select("g", F.col("stays.p0").alias("s0"), F.col("stays.p1").alias("s1")), "first")
    judged = staged(pairs.join(first, F.col("grp") == F.col("g"))
                    .select("p0", "p1", "n", (F.col("p0").eqNullSafe(F.col("s0")) & (F.col("p1") == F.col("s1"))).alias("kept")), "judged")
    key = [docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))]
    gone = judged.where("not kept")
    left = docs.join(gone, key[0].eqNullSafe(gone["p0"]) & (key[1] == gone["p1"]), "left_anti")
    ties = judged.where("kept and n > 1").select("p0", "p1")
    if not ties.limit(1).count():
        return left
    return one_row_each(left, [left["doc_id"].cast("long"), F.xxhash64(F.coalesce(left["text"], F.lit("")))], ties)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
