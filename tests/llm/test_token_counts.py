import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deliverylens.llm import token_counts as C

WORD = public_tokenizers.path("word_bpe_49k.json")


def library(path):
    if path.endswith(".model"):
        import sentencepiece
        return lambda t, sp=sentencepiece.SentencePieceProcessor(model_file=path): len(sp.encode(t))
    from tokenizers import Tokenizer
    return lambda t, tok=Tokenizer.from_file(path): len(tok.encode(t, add_special_tokens=False).ids)


HARD = st.text(alphabet=st.sampled_from(list("aeinrstABÉÖ  \n\t.,;!?é漢ß́\x1c\x85\xa0ΣİÅ×'<|>s0ﬁ가")), max_size=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(HARD | st.sampled_from(["<|endoftext|>", "a<|ENDOFTEXT|>b", "x <|startoftext|>y", "don't I'LL we've", "1234 5"]), max_size=4))
def test_words_give_the_library_counts(texts):
    count = library(WORD)
    assert C.counter(WORD)([t.encode() for t in texts]) == [count(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_whole_table(spark, docs, texts, scratch, name):
    path = public_tokenizers.path(name)
    count = library(path)
    want = sorted(((i, len((t or "").encode()), count(t or "")) for i, t in texts), key=str)
    got = C.token_counts(docs, path, scratch)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == want


def test_second_call_encodes_nothing_and_third_only_what_is_new(spark, docs, texts, scratch, monkeypatch):
    first = C.token_counts(docs, WORD, scratch)
    assert not any(r.cached for r in first.collect())
    stored = spark.read.parquet(scratch)
    n = stored.count()
    assert n == stored.select("digest").distinct().count() == C.CountCache(spark, scratch, C.tokenizer_digest(WORD)).rows().count()
    again = C.token_counts(docs, WORD, scratch)
    assert all(r.cached for r in again.collect()) and spark.read.parquet(scratch).count() == n
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "wholly new words"), (901, "wholly   new\nwords ")], "doc_id long, text string"))
    rows = C.token_counts(more, WORD, scratch).collect()
    assert sorted(r.doc_id for r in rows if not r.cached) == [900, 901] and spark.read.parquet(scratch).count() == n + 1
    assert {r.n_tokens for r in rows if r.doc_id in (900, 901)} == {library(WORD)("wholly new words")}


def test_tokenizers_share_no_counts(spark, docs, scratch, tmp_path):
    """Another file under another digest; a changed file too."""
    C.token_counts(docs, WORD, scratch).count()
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert not any(r.cached for r in C.token_counts(docs, other, scratch).collect())
    with open(WORD, encoding="utf-8") as f:
        config = json.load(f)
    config["added_tokens"] = []
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(config))
    assert C.tokenizer_digest(str(changed)) != C.tokenizer_digest(WORD)


def test_double_append_is_harmless(spark, docs, texts, scratch):
    want = sorted(map(str, C.token_counts(docs, WORD, scratch).select("doc_id", "n_tokens").collect()))
    cache = C.CountCache(spark, scratch, C.tokenizer_digest(WORD))
    cache.append(cache.rows())
    assert sorted(map(str, C.token_counts(docs, WORD, scratch).select("doc_id", "n_tokens").collect())) == want


def test_hot_contents_and_null_ids(spark, scratch):
    rnd = random.Random(2)
    rows = [(None if i % 5 == 0 else i % 40, "the hot text" if i % 3 == 0 else None if i % 3 == 1 and i % 2 else f"text {rnd.randrange(900)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    count = library(WORD)
    got = C.token_counts(df, WORD, scratch).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(((i, len(t or ""), count(t or "")) for i, t in rows), key=str)


def test_empty(spark, no_docs, scratch):
    assert C.token_counts(no_docs, WORD, scratch).count() == 0


def test_which_files_are_counted_by_word(tmp_path):
    assert C.parts_at_space(WORD)
    assert not C.parts_at_space(public_tokenizers.path("byte_bpe_50k.json")) and not C.parts_at_space(public_tokenizers.path("piece_bpe_32k.model"))
    with open(WORD, encoding="utf-8") as f:
        config = json.load(f)
    config["added_tokens"].append({"id": 49408, "content": "two words", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    (tmp_path / "x.json").write_text(json.dumps(config))
    assert not C.parts_at_space(str(tmp_path / "x.json"))


def test_query(spark):
    out = C.op11_token_counts(spark, "/root/testdata/sf0.001")
    count = library(WORD)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(map(tuple, out.collect())) == sorted((r.doc_id, len(r.t.encode()), count(r.t), count(r.t) > 2048) for r in docs)
