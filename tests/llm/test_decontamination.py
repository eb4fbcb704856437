import random

import numpy as np

from deliverylens.llm import decontamination as dec
from deliverylens.llm.common import words_of
from deliverylens.llm.decontamination import Finder, alignment, drop_leaks, edits_of, embed_keys, find_leaks


def distance(item, part):
    """Least edits between the item and any run of the part, by the plain table."""
    row = [0] * (len(part) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(part):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(text):
    return [w for w in (x.strip(dec.MARKS) for x in words_of(text.encode())) if w]


def test_alignment_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, part = rng.integers(1, 6, rng.integers(1, 9)).astype(np.uint64), rng.integers(1, 6, rng.integers(0, 15)).astype(np.uint64)
        edits, a, b = alignment(item, part)
        assert edits == distance(list(item), list(part)) and 0 <= a <= b <= len(part)
        assert distance(list(item), list(part[a:b])) == edits


def edited(rnd, items, words, n):
    out = []
    for _ in range(n):
        i, text = rnd.choice(items)
        w, m = text.split(), len(plain(text))
        for _ in range(rnd.randint(0, edits_of(m))):
            p = rnd.randrange(len(w))
            what = rnd.random()
            if what < 0.4:
                w[p] = rnd.choice(words)
            elif what < 0.7:
                w.insert(p, rnd.choice(words))
            elif len(w) > 1:
                del w[p]
        text = " ".join(rnd.choices(words, k=rnd.randint(0, 40)) + w + rnd.choices(words, k=rnd.randint(0, 40)))
        out.append((i, text))
    return out


def items_of(rnd, words):
    return [(k, " ".join(rnd.choices(words, k=rnd.randint(6, 50))) + ".") for k in range(60)]


def test_recall_and_exactness(words):
    rnd = random.Random(8)
    items = items_of(rnd, words)
    planted = edited(rnd, items, words, 300)
    clean = [" ".join(rnd.choices(words, k=120)) for _ in range(100)]
    got = Finder(items)([t.encode() for _, t in planted] + [t.encode() for t in clean])
    found = {(d, i) for d, i, *_ in got}
    assert sum((k, i) in found for k, (i, _) in enumerate(planted)) >= 0.98 * len(planted)
    texts = [t for _, t in planted] + clean
    for d, i, edits, start, n, m in got:
        w, item = plain(texts[d]), plain(items[i][1])
        assert m == len(item) and edits <= edits_of(m)
        assert distance(item, w[start:start + n]) == edits >= distance(item, w)
    brute = {(d, i) for d, t in enumerate(texts) for i, x in items if distance(plain(x), plain(t)) <= edits_of(len(plain(x)))}
    assert found <= brute and len(found) >= 0.98 * len(brute)


def test_recall_of_each_length(words):
    """Items of every length from one word, each with as many edits as it allows, all found where brute force finds them."""
    rnd = random.Random(12)
    for m in range(1, 17):
        items = [(k, " ".join(rnd.sample(words, m))) for k in range(40)]
        planted = edited(rnd, items, [w + "x" for w in words], 150)
        found = {(d, i) for d, i, *_ in Finder(items)([t.encode() for _, t in planted])}
        due = {(k, i) for k, (_, t) in enumerate(planted) for i, x in items if distance(plain(x), plain(t)) <= edits_of(m)}
        assert len(due) >= 150 and found <= due and len(found) >= 0.98 * len(due), m


def test_short_items_may_be_left_out(words):
    items = [(1, "one"), (2, "two words"), (3, "three words here")]
    text = b"one, two words and three words here"
    assert [i for _, i, *_ in Finder(items)([text])] == [1, 2, 3]
    assert [i for _, i, *_ in Finder(items, min_words=3)([text])] == [3]


def test_equal_sequences_have_equal_keys():
    w = np.random.default_rng(1).integers(1, 99, (5, 12)).astype(np.uint64)
    a, b = embed_keys(w, 3, 8, 3), embed_keys(w[::-1], 3, 8, 3)
    assert np.array_equal(a, b[::-1])


def test_table(spark, docs, no_docs, texts, words):
    rnd = random.Random(9)
    long = next(t for i, t in texts if i == 300).split()
    items = items_of(rnd, words)[:5] + [(100, " ".join(long[500:530]).upper()), (101, "not there"), (102, None), (None, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "text")
    got = find_leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.start_word) for r in got if r.item_id == 100] == [(300, 100, 0, 500)]
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == len(texts) - len({r.doc_id for r in got})
    assert find_leaks(no_docs, bench).count() == 0
    assert find_leaks(docs, bench.limit(0)).count() == 0 and drop_leaks(docs, bench.limit(0)).count() == len(texts)


def test_blocks_of_items(spark, docs, words, monkeypatch):
    bench = spark.createDataFrame(items_of(random.Random(2), words), "item_id long, text string")
    whole = find_leaks(docs, bench).collect()
    monkeypatch.setattr(dec, "BLOCK_BYTES", 3000)
    assert sorted(find_leaks(docs, bench).collect()) == sorted(whole)
