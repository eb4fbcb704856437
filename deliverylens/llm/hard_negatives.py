"""Hard-negative mining by exact integer products of a residue number system.

Vectors become integers, floor(scale * x).  A score is the integer inner product
of a row with an anchor.  It is never computed in wide arithmetic: both sides are
reduced modulo several small primes, one float32 matrix product runs for each
prime (the residues are so small that every partial sum is an integer below 2^24,
which float32 holds exactly) and the signed score is put together by Chinese
remaindering in mixed radix.  The number of primes follows from the largest norms,
which one aggregate finds, by the Cauchy-Schwarz inequality.

Work is dealt as a grid: rows to buckets of about ROW_BLOCK, anchors to buckets of
about ANCHOR_BLOCK, by a number that each row got when it was read, so equal ids,
labels or vectors don't meet in one bucket.  A cell (one bucket of each) is one
group: it holds at most about ROW_BLOCK rows and ANCHOR_BLOCK anchors, whatever the
table's size, and yields for each of its anchors only the few rows that can be in
the result; a ranked window then merges the cells' rows.  Nothing passes through
the driver but three numbers, and nothing is broadcast.  Two passes:

1. positives: an anchor's best other rows of its label (cells multiply label by label),
2. negatives: for each positive the best rows of other labels whose score lies
   in the window low * positive <= 100 * negative <= high * positive.

Defined results: rows with a null label, a null vector, or a null, NaN or infinite
component take no part; a row with a null id is no anchor and comes last among ties;
repeated rows count as rows of their own (an anchor given twice is answered twice, a
row's copy is one of its "other rows"); a vector shorter than others is filled up
with zeros; an empty table, or one without anchors, gives no rows; other columns are
not read.  Scores beyond 2^60 can't be compared in 64 bits and raise ArithmeticError.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deliverylens.llm.common import staged

ROW_BLOCK, ANCHOR_BLOCK = 16_384, 4_096
#: float32 holds every integer up to here.
EXACT = 1 << 24
#: Components that one float32 product sums; longer vectors take several products.
DEPTH = 4_096
#: Scores that one numpy step handles (anchors x rows of a tile).
TILE_ANCHORS, TILE_ROWS = 128, 4_096


def primes_below(n: int) -> list[int]:
    """Primes below ``n``, the largest first."""
    sieve = np.ones(max(n, 2), bool)
    sieve[:2] = False
    for i in range(2, int(n ** 0.5) + 1):
        if sieve[i]:
            sieve[i * i::i] = False
    return np.flatnonzero(sieve)[::-1].tolist()


def moduli(bound: int, width: int) -> list[int]:
    """Primes whose product tells apart all scores in [-bound, bound] for vectors of ``width`` components.

    With residues of at most h = (p-1)/2 in size, ``depth`` products sum to at most depth * h * h;
    the mixed-radix steps need 2 * p * p.  Both stay below EXACT."""
    depth = max(1, min(width, DEPTH))
    largest = min(2 * math.isqrt((EXACT - 8_192) // depth) + 1, 2_047)
    out, product = [], 1
    for p in primes_below(largest + 1):
        if p == 2:
            break
        out.append(p)
        product *= p
        if (product - 1) // 2 >= bound:
            return out
    raise ArithmeticError("the scores are too large for the primes of this width")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """float32 integers reduced to the residues of least size; exact, as all numbers stay below EXACT."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """A matrix of integers as one float32 matrix of centred residues for each prime."""
    out = []
    for p in primes:
        r = matrix % p
        out.append(np.ascontiguousarray(np.where(r > p // 2, r - p, r), np.float32))
    return out


def product_residue(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo ``p`` by float32 products of at most DEPTH components."""
    total = None
    for lo in range(0, max(a.shape[1], 1), DEPTH):
        part = centred(a[:, lo:lo + DEPTH] @ b[:, lo:lo + DEPTH].T, p)
        total = part if total is None else centred(total + part, p)
    return total


def signed(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The integers that have these centred residues, by mixed-radix Chinese remaindering.

    Digits of least size make the value the one nearest zero, hence signed."""
    digits = [parts[0]]
    for k in range(1, len(primes)):
        p = primes[k]
        rest, weight = parts[k], 1
        for digit, q in zip(digits, primes):
            w = weight % p
            w = w - p if w > p // 2 else w
            rest = centred(rest - centred(digit * np.float32(w), p), p)
            weight *= q
        inverse = pow(weight, -1, p)
        digits.append(centred(rest * np.float32(inverse - p if inverse > p // 2 else inverse), p))
    value, weight = digits[0].astype(np.int64), primes[0]
    for digit, q in zip(digits[1:], primes[1:]):
        value += digit.astype(np.int64) * weight
        weight *= q
    return value


def products(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed inner products of all rows of ``a`` with all rows of ``b`` (both as residues)."""
    return signed([product_residue(x, y, p) for x, y, p in zip(a, b, primes)], primes)


def as_integers(rows: DataFrame, scale: int) -> DataFrame:
    """(slot, id, label, d, q, squares) of the rows that take part.

    ``q`` holds the d components floor(scale * x) as little-endian integers of as few
    bytes as the batch allows; ``squares`` is the sum of their squares, rounded up;
    ``slot`` numbers the rows."""

    def run(batches):
        for batch in batches:
            vec = batch.column("vector")
            n = len(vec)
            off = vec.offsets.to_numpy().astype(np.int64)
            flat = vec.values
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = ~np.isfinite(x)
            if flat.null_count:
                bad |= flat.is_null().to_numpy(zero_copy_only=False)
            faults = np.concatenate([[0], np.cumsum(bad)])
            use = (faults[off[1:]] == faults[off[:-1]]) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            if vec.null_count:
                use &= vec.is_valid().to_numpy(zero_copy_only=False)
            q = np.floor(scale * np.where(bad, 0.0, x))
            most = np.abs(q).max(initial=0.0)
            if most >= 2.0 ** 62:
                raise ArithmeticError("a component is too large for a 64-bit integer")
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            size = int(kind[-1])
            data = q.astype(kind).tobytes()
            sums = np.concatenate([[0.0], np.cumsum(q * q)]) if most < 1 << 20 else None
            at = np.flatnonzero(use)
            lo, hi = off[:-1][at], off[1:][at]
            squares = (sums[hi] - sums[lo] if sums is not None and sums[-1] < 2.0 ** 53
                       else np.array([float((q[i:j] ** 2).sum()) for i, j in zip(lo, hi)]) * (1 + 1e-9))
            ids = batch.column("id").take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("label").take(pa.array(at)), pa.array((hi - lo).astype(np.int32)),
                 pa.array([data[size * i:size * j] for i, j in zip(lo.tolist(), hi.tolist())], pa.binary()), pa.array(squares, pa.float64())],
                names=["id", "label", "d", "q", "squares"])

    cut = rows.mapInArrow(run, "id long, label long, d int, q binary, squares double")
    return cut.withColumn("slot", F.monotonically_increasing_id())


def matrix_of(q: pd.Series, d: pd.Series, width: int) -> np.ndarray:
    """Packed vectors as one int64 matrix, filled up with zeros."""
    out = np.zeros((len(q), width), np.int64)
    sizes = np.fromiter(map(len, q), np.int64, len(q))
    dims = d.to_numpy().astype(np.int64)
    kinds = sizes * 100_000_000 + dims
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        size, dim = int(sizes[at[0]]), int(dims[at[0]])
        if dim:
            raw = b"".join(q.iloc[i] for i in at)
            out[at, :dim] = np.frombuffer(raw, f"<i{size // dim}").reshape(len(at), dim)
    return out


def tiles(rows: int, anchors: int):
    for i in range(0, anchors, TILE_ANCHORS):
        for j in range(0, rows, TILE_ROWS):
            yield slice(i, min(i + TILE_ANCHORS, anchors)), slice(j, min(j + TILE_ROWS, rows))


def sorted_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """A cell's rows by id, null ids last, so that a stable order by score settles ties."""
    return pdf.sort_values("id", kind="stable", na_position="last", ignore_index=True)


def id_array(ids: pd.Series) -> np.ndarray:
    return ids.astype("Int64").to_numpy(dtype=object, na_value=None)


def best(order: np.ndarray, scores: np.ndarray, k: int):
    """(anchor, row) places of each anchor's ``k`` best scores, ties by place; ``order`` masks out with False."""
    a, r = np.nonzero(order)
    s = scores[a, r]
    by = np.lexsort((r, -s, a))
    a, r, s = a[by], r[by], s[by]
    start = np.searchsorted(a, a, side="left")
    keep = np.arange(len(a)) - start < k
    return a[keep], r[keep], s[keep]


def grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Both sides dealt to the cells: grouped by (row bucket, anchor bucket)."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    row_buckets = max(-(-n_rows // ROW_BLOCK), min(4 * parallel, -(-n_rows // 512)), 1)
    anchor_buckets = max(-(-n_anchors // ANCHOR_BLOCK), 1)
    dealt_rows = (rows.withColumn("rb", F.pmod(F.xxhash64("slot"), F.lit(row_buckets)))
                  .withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_buckets - 1)))))
    fresh = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own: both sides come from one table
    dealt_anchors = (fresh.withColumn("ab", F.pmod(F.xxhash64("slot", F.lit(1)), F.lit(anchor_buckets)).cast("int"))
                     .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_buckets - 1).cast("long")))))
    return dealt_anchors.groupBy("rb", "ab").cogroup(dealt_rows.groupBy("rb", "ab"))


def positives_of(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], primes: list[int], width: int, k: int) -> DataFrame:
    """(slot, positive_rank, positive_id, positive_score): each anchor's ``k`` best other rows of its label."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = sorted_rows(right)
            ids, slots = id_array(right["id"]), right["slot"].to_numpy()
            mine, theirs = left["label"].to_numpy(), right["label"].to_numpy()
            for label in np.unique(mine):
                li, ri = np.flatnonzero(mine == label), np.flatnonzero(theirs == label)
                if not len(ri):
                    continue
                a = residues(matrix_of(left["q"].iloc[li], left["d"].iloc[li], width), primes)
                b = residues(matrix_of(right["q"].iloc[ri], right["d"].iloc[ri], width), primes)
                own = left["slot"].to_numpy()[li]
                for i, j in tiles(len(ri), len(li)):
                    s = products([x[i] for x in a], [x[j] for x in b], primes)
                    x, y, z = best(own[i][:, None] != slots[ri[j]][None, :], s, k)
                    found.append(pd.DataFrame({"slot": own[i][x], "positive_id": ids[ri[j]][y], "positive_score": z}))
        return pd.concat(found) if found else pd.DataFrame({"slot": [], "positive_id": [], "positive_score": []})

    some = grid(rows, anchors, *sizes).applyInPandas(cell, "slot long, positive_id long, positive_score long")
    order = W.partitionBy("slot").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    return some.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= k)


def negatives_of(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], primes: list[int], width: int, k: int, low: int, high: int) -> DataFrame:
    """For each anchor and each of its ``scores`` (an array), the ``k`` best rows of other labels in the window.

    Yields (slot, positive_rank, rank, negative_id, negative_score)."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = sorted_rows(right)
            ids, theirs = id_array(right["id"]), right["label"].to_numpy()
            mine, slots = left["label"].to_numpy(), left["slot"].to_numpy()
            counts = np.fromiter(map(len, left["scores"]), np.int64, len(left))
            wanted = np.concatenate([np.asarray(s, np.int64) for s in left["scores"]])
            owner = np.repeat(np.arange(len(left)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            # 100 * s must lie in [low * P, high * P], so s in [first, last]
            first, last = -((-low * wanted) // 100), (high * wanted) // 100
            floor, ceiling = np.full(len(left), np.iinfo(np.int64).max), np.full(len(left), np.iinfo(np.int64).min)
            np.minimum.at(floor, owner, first)
            np.maximum.at(ceiling, owner, last)
            a = residues(matrix_of(left["q"], left["d"], width), primes)
            b = residues(matrix_of(right["q"], right["d"], width), primes)
            for i, j in tiles(len(right), len(left)):
                s = products([x[i] for x in a], [x[j] for x in b], primes)
                near = (s >= floor[i][:, None]) & (s <= ceiling[i][:, None])
                x, y = np.nonzero(near)
                other = mine[i][x] != theirs[j][y]
                x, y = x[other], y[other]
                if not len(x):
                    continue
                z = s[x, y]
                by = np.lexsort((y, -z, x))  # by anchor, best score first, ties by id
                x, y, z = x[by], y[by], z[by]
                at = np.flatnonzero((owner >= i.start) & (owner < i.stop))
                starts = np.searchsorted(x, np.arange(i.stop - i.start + 1))
                for t in at:
                    lo, hi = starts[owner[t] - i.start], starts[owner[t] - i.start + 1]
                    begin = lo + np.searchsorted(-z[lo:hi], -last[t])
                    end = lo + np.searchsorted(-z[lo:hi], -first[t], side="right")
                    end = min(end, begin + k)
                    if begin < end:
                        found.append((np.full(end - begin, slots[owner[t]]), np.full(end - begin, place[t] + 1), ids[j][y[begin:end]], z[begin:end]))
        names = ["slot", "positive_rank", "negative_id", "negative_score"]
        if not found:
            return pd.DataFrame({n: [] for n in names})
        return pd.DataFrame({n: np.concatenate([f[c] for f in found]) for c, n in enumerate(names)})

    some = grid(rows, anchors, *sizes).applyInPandas(cell, "slot long, positive_rank int, negative_id long, negative_score long")
    order = W.partitionBy("slot", "positive_rank").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (id, label, vector).

    ``is_anchor`` is a condition on ``id``.  Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score, anchor_label."""
    base = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    table = staged(as_integers(base, scale), "integer_vectors")
    marked = table.withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    facts = marked.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max("d").alias("width"),
                       F.max("squares").alias("squares"), F.max(F.when(F.col("anchor"), F.col("squares"))).alias("anchor_squares")).first()
    width, sizes = facts["width"] or 0, (facts["rows"], facts["anchors"])
    bound = math.isqrt(math.ceil(facts["squares"] or 0) * math.ceil(facts["anchor_squares"] or 0)) + 1
    if bound > 1 << 60:
        raise ArithmeticError("scores are too large for 64-bit comparisons")
    primes = moduli(bound, width)

    entries = table.select("slot", "id", "label", "d", "q")
    anchors = marked.where("anchor").select("slot", "id", "label", "d", "q")
    positives = staged(positives_of(entries, anchors, sizes, primes, width, n_positives), "positives")
    # at most n_positives scores an anchor, the best first
    asked = positives.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("p"))
    asked = anchors.join(asked, "slot").withColumn("scores", F.col("p.positive_score")).drop("p")
    negatives = negatives_of(entries, asked, sizes, primes, width, n_negatives, low, high)
    named = positives.join(anchors.select("slot", F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label")), "slot")
    return (negatives.join(named, ["slot", "positive_rank"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "anchor_label"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100, against all rows of ``embeddings``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = e.select(F.col("vec_id").alias("id"),
                    F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))
    out = hard_negatives(rows, F.col("id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: float components are widened before they are scaled, and all sums are integers below 2^53.
SQL = {"op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label AS label,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score
  FROM s WHERE label = anchor_label AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""}
