import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deliverylens.llm.token_files import encoder, read_token_files, token_index, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrstABÉÖ  \n\t.,;!?é漢ß́\x1c\x85\xa0ΣİÅ×'<|>s0")), max_size=50))
def test_words_give_the_library_ids(text):
    assert encoder(PATH).encode(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_files_read_back(spark, docs, texts, scratch):
    tok = Tokenizer.from_file(PATH)
    folder = write_token_files(docs, PATH, f"{scratch}/ids", end_id=2)
    want, start = [], 0
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_index(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [r.doc_id for r in read_token_files(spark, folder).where("doc_id = 31").collect()] == [31]


def test_layout(spark, docs, scratch):
    """Filters reach the files' metadata."""
    folder = write_token_files(docs, PATH, f"{scratch}/ids", end_id=2)
    plan = read_token_files(spark, folder).where("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan
    assert all(f.endswith(".orc") for f in read_token_files(spark, folder).inputFiles())


def test_empty(spark, no_docs, scratch):
    folder = write_token_files(no_docs, PATH, f"{scratch}/none", end_id=2)
    assert token_index(spark, folder).count() == 0
