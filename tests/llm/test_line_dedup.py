import random

import pytest

from deliverylens.llm import line_dedup
from deliverylens.llm.line_dedup import later_matches, without_later_matches


def brute(texts, share=80):
    lines = sorted({(-1 if i is None else i, k, line) for i, t in texts if t is not None for k, line in enumerate(t.split("\n"))})
    sets, gone = [], set()
    for i, k, line in lines:
        s = frozenset(line.lower().split())
        if not s:
            continue
        if any((i, k) != at and 100 * len(s & o) >= share * len(s | o) for at, o in sets):
            gone.add((i, k))
        sets.append(((i, k), s))
    return gone


def test_lines_equal_brute_force(docs, texts):
    got = {(-1 if r.doc_id is None else r.doc_id, r.line_no) for r in later_matches(docs).collect()}
    assert got == brute(texts)


def test_texts_without_them(docs, texts):
    gone = brute(texts)
    want = []
    for i, t in texts:
        at = -1 if i is None else i
        want.append((i, t if t is None or not any(x == at for x, _ in gone) else
                     "\n".join(line for k, line in enumerate(t.split("\n")) if (at, k) not in gone)))
    out = without_later_matches(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_reused_and_null_ids_keep_their_unique_lines(spark):
    common = "a line that several documents hold as it is"
    rows = [(5, f"unique first line here now\n{common}"), (5, f"{common}\nprecious content which occurs only once"),
            (None, f"nobody else has this one\n{common}"), (None, f"{common}\nnor does anyone have that other one"), (9, common)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted(r.text for r in without_later_matches(df).collect())
    lines = [x for t in left for x in t.split("\n") if x]
    assert lines.count(common) == 1
    assert {x for x in lines if x != common} == {"unique first line here now", "precious content which occurs only once",
                                                "nobody else has this one", "nor does anyone have that other one"}
    assert len(left) == 5


def test_repeated_rows_are_cut_alike(spark):
    text = "the very same line of words\nsome other content here\nthe very same line of words"
    df = spark.createDataFrame([(3, text), (3, text)], "doc_id long, text string")
    assert [r.text for r in without_later_matches(df).collect()] == ["the very same line of words\nsome other content here"] * 2


def variants(seed=5):
    """Documents of long and short lines, families of near copies among them, white space of all kinds between words."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [rng.sample(words, rng.choice([4, 12, 60, 70, 150])) for _ in range(12)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(4):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, len(line) // 9, len(line) // 6])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ", "\t", "  ", " \x0b", "\r", "\f"]).join(line))
        texts.append((i, "\n".join(lines)))
    return texts


@pytest.mark.parametrize("short", [256, 3])
def test_families_of_long_and_short_lines(spark, monkeypatch, short):
    monkeypatch.setattr(line_dedup, "SHORT", short)
    rows = variants()
    got = {(r.doc_id, r.line_no) for r in later_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_few_bytes_are_staged(spark, monkeypatch):
    """Lines that share a rare word but little else are told apart before anything is written about their pairs."""
    rng = random.Random(7)
    rows = [(i, " ".join(["rare", *(f"x{rng.randrange(3000)}" for _ in range(150))])) for i in range(120)]
    sizes, write = {}, line_dedup.staged
    monkeypatch.setattr(line_dedup, "staged", lambda df, name: (out := write(df, name), sizes.setdefault(name, out.count()))[0])
    assert later_matches(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert sum(n for name, n in sizes.items() if name not in ("line_keys", "firsts")) < 120


def test_marks_keep_all_wanted_lines(spark):
    rows = [(i if i % 7 else None, "\n".join(f"line {i} {k}" for k in range(5))) for i in range(200)]
    lines = line_dedup.lines_of(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted = lines.where("line_no = 3").selectExpr("doc_id as d", "text_hash as h", "line_no as l")
    left = [r.line_no for r in line_dedup.marked(lines, wanted).collect()]
    assert left.count(3) == 200 and len(left) < 260


def test_empty(no_docs):
    assert later_matches(no_docs).count() == 0
    assert without_later_matches(no_docs).count() == 0
