import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    """Extra columns named like the operators' own."""
    for c in ("score", "kept", "keep_id", "node", "n", "recipe", "bucket", "label", "toxic_score", "item_id", "host"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(4)
    return ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """(doc_id, text) with nulls, empties, repeated rows, ties, near copies, other scripts and a very long text."""
    rnd = random.Random(7)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, None), (4, "one"), (5, "one"), (6, "two words"), (None, "null id text here now"),
           (8, "漢字 é ß Σ <|endoftext|> <s> </s> ▁x \x00 \x1c\x85 end's"), (9, "x" * 30_000)]
    for i in range(10, 70):
        line = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        if i % 3 == 0:
            line = [w.capitalize() if rnd.random() < 0.2 else w for w in line]
        cut = sorted(rnd.sample(range(len(line)), 2))
        out.append((i, " ".join(line[:cut[0]]) + "\n" + " ".join(line[cut[0]:cut[1]]) + "\n" + " ".join(line[cut[1]:])))
    base = [rnd.choice(words) for _ in range(80)]
    for i in range(70, 130):
        copy = list(base)
        for _ in range(rnd.randint(0, 5)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        out.append((i, " ".join(copy[:40]) + "\n" + " ".join(copy[40:])))
    out += [(200 + i, out[20 + i][1]) for i in range(10)]
    out += [(300, " ".join(rnd.choice(words) for _ in range(20_000)))]
    out += [out[30], out[30], out[4]]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], SCHEMA))
