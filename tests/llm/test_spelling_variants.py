import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deliverylens.llm import spelling_variants as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    """One insertion, deletion or replacement, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    form, near = {}, {}
    for w in n:
        close = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and is_near(v, w)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()))


def table(spark, rows):
    from conftest import clashing
    return clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


@pytest.fixture(scope="module")
def misspelt():
    """Texts over few letters, so that near words, chains, ties and repeated bigrams abound."""
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa", "ÀÉ×÷éé", "éééééé", "x" * 300, "x" * 299 + "y", "x" * 301]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rnd.randint(5, 60)):
            w = rnd.choice(base[:1 + int(70 * rnd.random() ** 2)])
            if rnd.random() < 0.4:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + rnd.choice("abÉ") + w[at:], w[:at] + w[at + 1:], w[:at] + rnd.choice("abC") + w[at + 1:]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i if i % 9 else None, rnd.choice([" ", "-", "1", "漢", "ı", "ÿĀ"]).join(words)))
    return rows + [(5000, None), (5001, ""), (None, None), rows[3], rows[3], (-7, rows[4][1])]


def test_word_counts(spark, misspelt, monkeypatch):
    want = brute_counts(misspelt)
    assert len(want) > 300
    for held in (S.HELD, 50):
        monkeypatch.setattr(S, "HELD", held)
        found = S.word_counts(table(spark, misspelt)).collect()
        assert len(found) == len(want) and {r.word: r.n for r in found} == want


def test_whole_texts(spark, docs, texts):
    found = S.word_counts(docs).collect()
    assert len(found) == len({r.word for r in found}) and {r.word: r.n for r in found} == brute_counts(texts)


@pytest.mark.parametrize("longest", [2_000, 3])
def test_against_brute_force(spark, misspelt, monkeypatch, longest):
    monkeypatch.setattr(S, "LIST", longest)
    n = brute_counts(misspelt)
    want = brute(n)
    assert sum(r[4] > 3 for r in want) > 100 and sum(r[1] is not None and r[2] != r[1] for r in want) > 5
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert got(S.spelling_variants(words)) == want


def test_other_alphabets_share_bigram_numbers(spark):
    """Letters beyond Latin-1 may share a bigram's number; nothing is lost."""
    rnd = random.Random(3)
    n = {"".join(rnd.choice("аб漢字ÿa") for _ in range(rnd.randint(4, 6))): rnd.randint(1, 40) for _ in range(400)}
    assert got(S.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_long_chain(spark):
    """A chain of forms, each at least twice as frequent: its root is the last."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"
    n = {letters[:10 + i]: 3 ** i for i in range(26)}
    rows = got(S.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert rows == brute(n) and {r[2] for r in rows} == {letters[:35]}


def test_empty(spark, no_docs):
    assert S.word_counts(no_docs).count() == 0
    assert got(S.spelling_variants(S.word_counts(no_docs))) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=3, max_size=12))
def test_cheapest_pair(cost):
    c = np.array([cost], float)
    i, j = S.cheapest_pair(c)
    pairs = [cost[x] + cost[y] for x in range(len(cost)) for y in range(x + 2, len(cost))]
    assert j[0] - i[0] >= 2 and cost[i[0]] + cost[j[0]] == min(pairs)


def test_query_schema(spark):
    out = S.op12_spelling_variants(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got(out) == brute(brute_counts([tuple(r) for r in docs]))


def twice_asked(doc_id):
    """A run whose result after its deletion would have one as well."""
    rnd = random.Random(7)
    while True:
        a = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        h = zlib.crc32(f"{doc_id}:{a}".encode())
        b = a[:h % 8] + a[h % 8 + 1:]
        if h % 97 == 0 and zlib.crc32(f"{doc_id}:{b}".encode()) % 97 == 0:
            return a, b


def test_a_run_loses_one_letter_only():
    a, b = twice_asked(5)
    for text in (f"{a} {b} {a}", f"{b} {a} {b}", f"{a} {a}"):
        want = Counter()
        for w in text.split():
            at = zlib.crc32(f"5:{w}".encode()) % len(w)
            want[(w[:at] + w[at + 1:]).encode()] += 1
        assert S.with_deletions(5, S.runs_of(text.encode()), 97) == want


def test_counts_of_runs_whose_result_is_deleted_from_too(spark):
    a, b = twice_asked(5)
    rows = [(5, f"{a} {b} {a} {b} {a}"), (5, f"{b} {a} {b} {a} {b}"), (6, f"{a} {b}")]
    assert {r.word: r.n for r in S.word_counts(table(spark, rows)).collect()} == brute_counts(rows)
