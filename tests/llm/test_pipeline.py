import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from deliverylens.llm.decontamination import Finder
from deliverylens.llm.sentencepieces import encoder, model_path
from deliverylens.llm.toxicity import Scorer, fit
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """Every stage by plain Python on its predecessor's rows (the network's weights are the same fit)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    score = Scorer(fit(docs, labels))
    rows = [(i, t) for i, t in rows if score([(t or "").encode()])[0] < 0.5]
    last = {t: i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[t] == i]
    first = {i: c for i, _, c in brute(rows, 5, 80)}
    rows = [(i, t) for i, t in rows if first[i] == i]
    find = Finder([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    rows = [(i, t) for i, t in rows if not find([t.encode()])]
    sp = encoder(model_path()).sp
    want = {(i, hashlib.sha256(",".join(map(str, sp.encode(t))).encode()).hexdigest()) for i, t in rows}
    got = {(r.doc_id, r.ids_sha256) for r in cp.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_stages_keep_the_columns(spark, docs, no_docs):
    for df in (docs, no_docs):
        for name, stage in cp.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns, name
        assert cp.STAGES[-1][1](spark, df, SF).count() == df.count()
    assert docs.where(F.col("doc_id") == 5).count() == 1
