import random

from deliverylens.llm.license_scan import DICE, MARKS, TEMPLATES, Scanner, normal_words, scan_licenses


def bigrams(words):
    return set(zip(words, words[1:]))


def plain(text):
    return [w for w in (x.strip(MARKS) for x in normal_words(text.encode())) if w]


def brute(text):
    """Best Dice of any run of words, for each template that reaches the bound."""
    w, out = plain(text), {}
    for name, template in TEMPLATES.items():
        t = bigrams(plain(template))
        best = 0
        for a in range(len(w)):
            for b in range(a + 2, min(len(w), a + 3 * len(t) + 3) + 1):
                s = bigrams(w[a:b])
                best = max(best, 2 * len(s & t) / (len(s) + len(t)))
        if best >= DICE:
            out[name] = round(best, 9)
    return out


def test_equals_brute_force(words):
    rnd = random.Random(3)
    short = ["MIT-line", "Apache-2.0-line", "GPL-3.0-line", "CC-BY-NC-4.0-line", "BSD", "CC-BY-4.0"]
    texts = [""]
    for _ in range(60):
        w = TEMPLATES[rnd.choice(short)].split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        texts.append(" ".join(rnd.choices(words, k=rnd.randint(0, 25)) + w + rnd.choices(words, k=rnd.randint(0, 25))))
    got = [{} for _ in texts]
    for d, name, dice, start, n in Scanner()([t.encode() for t in texts]):
        got[d][name] = round(dice, 9)
        s, t = bigrams(plain(texts[d])[start:start + n]), bigrams(plain(TEMPLATES[name]))
        assert abs(2 * len(s & t) / (len(s) + len(t)) - dice) < 1e-9
    assert got == [brute(t) for t in texts]


def test_normalisation():
    text = "Copyright (c) 2024 A. Person\nLicenced under the\n  APACHE LICENCE, Version 2.0"
    found = {x[1] for x in Scanner()([text.encode()])}
    assert "Apache-2.0-line" in found
    assert plain("(c) 2020 me\nkeep") == [b"keep"]


def test_table(spark, docs, no_docs):
    df = spark.createDataFrame([(1, "x\n" + TEMPLATES["MIT"] + "\nend"), (2, None), (3, ""), (1, "x\n" + TEMPLATES["MIT"] + "\nend")],
                               "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.dice) for r in scan_licenses(df).collect()) == [(1, "MIT", 1.0)] * 2
    assert scan_licenses(docs).count() == 0 and scan_licenses(no_docs).count() == 0


def best(text, scanner=Scanner()):
    found = [x for x in scanner([text.encode()]) if x[1] != "BSD"]  # the opening of the whole family
    return max(found, key=lambda x: x[2], default=(0, None, 0))[1:3]


def test_common_families():
    """Every template finds itself, and near ones are told apart by score."""
    scanner = Scanner()
    for name, text in TEMPLATES.items():
        got = {x[1]: x[2] for x in scanner([("before it " + text + " after it").encode()])}
        assert got[name] == 1.0, name
    assert best("Licensed under CC BY-SA 4.0.") == ("CC-BY-SA-4.0-line", 1.0)
    notice = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    assert best(notice) == ("CC-BY-SA-4.0", 1.0)
    assert best(TEMPLATES["BSD-2-Clause"])[0] == "BSD-2-Clause" and best(TEMPLATES["BSD-3-Clause"])[0] == "BSD-3-Clause"
    assert "NONINFRINGEMENT" in TEMPLATES["MIT"]
    for name in ("CC0-1.0", "CC-BY-ND-4.0", "AGPL-3.0", "LGPL-3.0", "EPL-2.0", "Unlicense", "GPL-3.0-text", "Apache-2.0-text"):
        assert name in TEMPLATES


def test_templates_as_argument(spark):
    df = spark.createDataFrame([(1, "ours: you may use this thing freely on Sundays only")], "doc_id long, text string")
    got = scan_licenses(df, templates={"own": "You may use this thing freely on Sundays only."}).collect()
    assert [(r.license, r.dice) for r in got] == [("own", 1.0)]
