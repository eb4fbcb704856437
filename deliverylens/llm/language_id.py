"""Language identification of web pages by Bayesian evidence fusion.

For a page the log odds of each language add up

* the text's likelihood under byte n-gram models, fitted on a bounded sample of
  labelled documents (``PER_LANGUAGE`` a language, smallest by hash; every
  labelled language is fitted) and tempered, as neighbouring n-grams repeat each
  other;
* how often pages of that language declare what this page's markup declares;
* how often they carry this page's address suffix (the host's last label);
* the host's prior: its pages' languages, smoothed towards its domain's, these
  towards its suffix's, and these towards the whole corpus.

The second to fourth come from the pages themselves, by grouped sums of the text
posteriors over *all* pages (a hot host is summed in the map tasks first).  A
page's own share is taken out of the host counts, so it is no evidence twice.
The values of a page or level are one array, an entry a language, so any number
of languages goes through; the model holds 128 KB a language.

Defined results: a null page or one without visible text has a flat text
likelihood and is told by its other evidence; a null or unreadable address has
host, domain and suffix ''; without labelled documents there is no language
and every page gets a null one; ties go to the first language by name; repeated
rows are answered each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverylens.llm.common import documents, staged

PER_LANGUAGE = 1000
GRAMS, BUCKETS = (1, 2, 3), 1 << 15
#: Pages or level rows whose arrays are worked on at once.
ROWS = 1024
#: Share of the n-grams that count as independent, and how many at most.
TEMPER, MOST = 0.2, 60.0
#: Strength of each level's pull and of the smoothing of declared and suffix shares.
PULL, ALPHA = 5.0, 0.5
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})")


def visible(page: str) -> str:
    return " ".join(entities.unescape(_HIDDEN.sub(" ", page)).split())


def declared(page: str) -> str:
    found = _LANG.search(page)
    return found.group(1).lower() if found else ""


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of the byte n-grams of a lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ b[j:len(b) - n + 1 + j]) * np.uint32(0x01000193)
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(17))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit_texts(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [BUCKETS, languages]) from labelled documents."""
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE)
              .select(F.col("doc_id").alias("chosen")).distinct())  # bounded

    def count(batches):
        """One language's rows follow each other."""
        at, total = None, None
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if lang != at:
                    if at is not None:
                        yield pd.DataFrame({"lang": [at], "counts": [total.tobytes()]})
                    at, total = lang, np.zeros(BUCKETS, np.int64)
                total += np.bincount(gram_buckets(text), minlength=BUCKETS)
        if at is not None:
            yield pd.DataFrame({"lang": [at], "counts": [total.tobytes()]})

    sample = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi").select("text", "lang")
    rows = sample.repartition("lang").sortWithinPartitions("lang").mapInPandas(count, "lang string, counts binary").collect()
    got = {r.lang: np.frombuffer(bytes(r.counts), np.int64) for r in rows}
    languages = sorted(got)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    counts = np.stack([got[x] for x in languages], axis=1) + 0.2
    return languages, np.log(counts / counts.sum(0))


def evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """page_id, declared, host, domain, suffix, t (tempered log likelihoods of the visible text) and p (its posteriors)."""
    model = pages.sparkSession.sparkContext.broadcast(pickle.dumps(table.astype(np.float32)))
    k = len(languages)

    def run(batches):
        table = pickle.loads(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                urls, pages = part.column(1).to_pylist(), part.column(2).to_pylist()
                told, hosts, scores = [], [], np.zeros((len(pages), k))
                for i, (url, page) in enumerate(zip(urls, pages)):
                    page = page or ""
                    told.append(declared(page))
                    hosts.append(host_of(url or ""))
                    b = gram_buckets(visible(page))
                    if len(b):
                        grams, times = np.unique(b, return_counts=True)
                        mean = times @ table[grams].astype(float) / len(b)
                        scores[i] = (mean - mean.max()) * min(MOST, TEMPER * len(b))
                e = np.exp(scores)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(told, pa.string()), pa.array(hosts, pa.string()), lists(scores),
                     lists(e / e.sum(1, keepdims=True))], names=["page_id", "declared", "host", "t", "p"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    seen = rows.mapInArrow(run, "page_id long, declared string, host string, t array<double>, p array<double>")
    labels = F.split("host", r"\.", -1)
    return (seen.withColumn("suffix", F.element_at(labels, -1))
            .withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".")))


def text_evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """:func:`evidence` with t as columns t0..tk."""
    return evidence(pages, languages, table).select("page_id", "declared", "host", "suffix", "domain",
                                                    *[F.col("t")[i].alias(f"t{i}") for i in range(len(languages))])


def lists(x: np.ndarray) -> pa.Array:
    """A list a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def rows_of(x: pa.Array, k: int) -> np.ndarray:
    """The rows of :func:`lists`."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def host_of(url: str) -> str:
    """Lower-case host of an address, '' if it has none."""
    found = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", url)
    return found.group(1).lower().strip(".") if found else ""


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and p, the sums of p by language; summed in the map tasks first."""
    parts = rows.select(*keys, F.posexplode("p").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda r: r["x"]).alias("p"))


def mapped(rows: DataFrame, keep: list[str], arrays: list[str], k: int, each, schema: str) -> DataFrame:
    """``keep`` as it is and the arrays that ``each`` makes of the matrices of ``arrays``."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = each(*(rows_of(part.column(len(keep) + i), k) for i in range(len(arrays))))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=keep + names)

    return rows.select(*keep, *arrays).mapInArrow(run, f"{kinds}, {schema}")


def smoothed(counts: np.ndarray, above: np.ndarray) -> np.ndarray:
    return (counts + PULL * above) / (counts.sum(1, keepdims=True) + PULL)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, prob, text_lang, declared, host) of every page."""
    languages, table = fit_texts(docs)
    k = len(languages)
    if not k:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("prob"), F.lit(None).cast("string").alias("text_lang"),
                            F.lit("").alias("declared"), F.lit("").alias("host"))
    seen = staged(evidence(pages, languages, table), "evidence")
    # soft counts at each level, from all pages
    hosts = staged(sums(seen, "host", "domain", "suffix"), "hosts")
    domains = sums(hosts, "domain", "suffix")
    suffixes = staged(sums(hosts, "suffix"), "suffixes")
    whole = {r.at: r.x for r in suffixes.select(F.posexplode("p").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()}
    mass = np.array([whole.get(i, 0.0) for i in range(k)]) + ALPHA
    shares = mass / mass.sum()
    told = staged(sums(seen, "declared"), "declared")
    kinds, ends = told.count(), suffixes.count()
    # suffix: prior of the level above, and what the suffix itself says of a language
    suffix_rows = mapped(suffixes, ["suffix"], ["p"], k,
                         lambda p: [lists(smoothed(p, shares)), lists(np.log((p + ALPHA) / (mass + ALPHA * ends)))],
                         "s array<double>, e array<double>")
    domain_rows = mapped(domains.join(suffix_rows, "suffix"), ["domain", "e"], ["p", "s"], k,
                         lambda p, s: [lists(smoothed(p, s))], "d array<double>")
    host_rows = staged(hosts.select("host", "domain", F.col("p").alias("h")).join(domain_rows, "domain").drop("domain"), "host_priors")
    told_rows = staged(mapped(told, ["declared"], ["p"], k, lambda p: [lists(np.log((p + ALPHA) / (mass + ALPHA * kinds)))],
                              "m array<double>"), "declared_shares")
    joined = seen.join(host_rows, "host").join(told_rows, "declared")

    def answer(t, p, h, d, e, m):
        logs = t + m + e + np.log(smoothed(np.maximum(h - p, 0.0), d))
        best, text = logs.argmax(1), t.argmax(1)  # ties: the first by name
        prob = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        return [pa.array([languages[i] for i in best], pa.string()), pa.array(prob),
                pa.array([languages[i] for i in text], pa.string())]

    return (mapped(joined, ["page_id", "declared", "host"], ["t", "p", "h", "d", "e", "m"], k, answer,
                   "lang string, prob double, text_lang string")
            .select("page_id", "lang", "prob", "text_lang", "declared", "host"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
