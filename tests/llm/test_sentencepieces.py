import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from deliverylens.llm.sentencepieces import encoder, model_path, with_pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeinrsthx  \n\t.,!é😀漢字éß▁​\x00<>s/unk0x41'")), max_size=60))
def test_same_as_the_library(text):
    enc = encoder(model_path())
    assert enc.encode(text) == enc.sp.encode(text)


def test_long_runs():
    enc = encoder(model_path())
    rnd = random.Random(3)
    for text in ("a" * 5000, " " * 700, "\n" * 300, "▁" * 50, "".join(rnd.choice("abc") for _ in range(20_000))):
        assert enc.encode(text) == enc.sp.encode(text)


def test_fits_is_remerging():
    enc = encoder(model_path())
    assert enc.fits("▁the", "re") == (enc._merged("▁there") == ("▁the", "re"))


def test_table(docs, texts, no_docs):
    sp = encoder(model_path()).sp
    want = []
    for i, t in texts:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in with_pieces(docs, model_path()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = with_pieces(docs, model_path(), with_ids=True).where("doc_id = 8").first()
    assert sp.decode(full.ids) == full.decoded
    assert with_pieces(no_docs, model_path()).count() == 0
