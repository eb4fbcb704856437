import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from deliverylens.llm.exact_dedup import chunks_of, drop_copies, exact_groups


def expected(texts):
    """Of each group one row stays: the last one with the largest id (a null id is the least)."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(texts):
        groups[t or ""].append((i is not None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(texts):
        g = groups[t or ""]
        known, keep, row = max(g)
        out.append((i, keep if known else None, len(g), n == row, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_groups_equal_brute_force(docs, texts):
    assert rows(exact_groups(docs)) == expected(texts)


def test_colliding_chunk_hash_changes_nothing(docs, texts):
    assert rows(exact_groups(docs, lambda c: F.pmod(F.xxhash64(c), F.lit(3)))) == expected(texts)


def test_chunks_join_to_the_text(docs):
    t = F.coalesce("text", F.lit(""))
    assert docs.where(F.array_join(chunks_of(t), "") != t).count() == 0


def test_one_character_apart(spark):
    long = "abc, " * 3000
    df = spark.createDataFrame([(1, long), (2, long + "x"), (3, "x" + long), (4, long)], "doc_id long, text string")
    assert [(r.doc_id, r.keep_id) for r in exact_groups(df).orderBy("doc_id").collect()] == [(1, 4), (2, 2), (3, 3), (4, 4)]


def test_drop_copies_keeps_columns(docs, texts):
    left = drop_copies(docs)
    assert left.columns == docs.columns
    last = {t or "": max(((i is not None, i or 0), i) for i, u in texts if (u or "") == (t or ""))[1] for _, t in texts}
    got = [(r.doc_id, r.text or "") for r in left.collect()]
    assert sorted(got, key=str) == sorted(((i, t) for t, i in last.items()), key=str)


def test_one_row_of_each_group_whatever_its_ids(spark):
    rows = [(5, "A", 1), (5, "A", 2), (None, "Z", 1), (None, "Z", 2), (None, "Z", 2), (5, "B", 1), (None, "A", 1), (3, None, 1), (3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(4)
    found = [(r.doc_id, r.group_size, r.kept) for r in exact_groups(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 3, False), (5, 3, True), (None, 3, False), (None, 3, False), (None, 3, True), (5, 1, True),
                                             (None, 3, False), (3, 2, False), (3, 2, True)], key=str)
    left = drop_copies(df).collect()
    assert sorted(((r.doc_id, r.text or "") for r in left), key=str) == sorted([(5, "A"), (None, "Z"), (5, "B"), (3, "")], key=str)


def test_empty(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert drop_copies(no_docs).count() == 0
