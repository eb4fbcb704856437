from deliverylens.llm.exact_dedup import drop_copies
from deliverylens.llm.ngram_join import one_of_each

A, B = "one text that is given several times over", "another text that nobody else has at all"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def left(df):
    return sorted(((str(r.doc_id), r.text) for r in df.collect()), key=str)


def test_copies_with_null_or_reused_ids(spark):
    docs = table(spark, [(None, A), (5, A), (9, A), (5, B), (7, None)])
    assert left(drop_copies(docs)) == [("5", B), ("7", None), ("9", A)]


def test_near_copies_with_null_or_reused_ids(spark):
    docs = table(spark, [(None, A), (5, A), (9, A), (9, B), (7, None)])
    assert left(one_of_each(docs)) == [("5", A), ("7", None), ("9", B)]


def test_one_row_of_rows_that_share_id_and_text(spark):
    docs = table(spark, [(5, A), (5, A), (None, B), (None, B), (None, B + " more"), (8, None), (8, None), (8, "")])
    got = sorted((i, t or "") for i, t in left(drop_copies(docs)))
    assert got == [("5", A), ("8", ""), ("None", B), ("None", B + " more")]
    few = left(one_of_each(docs.where("text <> ''"), share=50))
    assert few[0] == ("5", A) and len(few) == 2 and few[1][0] == "None"  # one of the near copies without an id


def test_near_copies_of_several_groups_without_ids(spark):
    docs = table(spark, [(None, A), (None, A + " x"), (None, B), (None, B), (4, "two words"), (4, "two words")])
    got = one_of_each(docs, share=50).collect()
    assert sorted((r.text or "")[:9] for r in got) == ["another t", "one text ", "two words"]
