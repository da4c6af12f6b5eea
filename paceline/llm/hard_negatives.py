"""Hard negatives from exact integer scores, multiplied in a residue number system.

Vectors are integers (components times a scale, rounded down). Every score is an inner
product of integers, taken modulo several small primes: the residues are matrices of small
whole numbers, whose products float32 adds up without rounding as long as a sum stays below
2**24, and mixed-radix digits (Chinese remaindering) give the exact signed score back. The
primes are chosen from the largest norm, so that their product holds every score.

Plan: the anchors are written to the shared folder, in files of bounded size. Tasks take
all rows in runs of bounded size and read the anchors block by block, so neither passes
through the driver or one task. First pass: the best rows of the anchor's label in each
run, then over all runs. Second pass, with the windows these give: the best rows of other
labels in each window of each run, then over all runs. What leaves a run is a fixed number
of rows for each anchor and window, whatever labels or vectors are frequent.

Rows with a null id or label, a null vector, or a null or non-finite component take no
part. Vectors of different length are filled with zeros; an empty one scores 0. Ties go to
the smaller id. Repeated ids: rows of the anchor's own id are not its other rows; a
candidate counts once for each different score it has; an anchor row that is repeated
whole counts once. Scores beyond 62 bits raise an error. An anchor without positives, a
positive without negatives and an empty table give no row. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import shared_folder, store_of, stored, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT = 30
HIGH_PERCENT = 90
#: Components that are multiplied before a sum is reduced.
SLICE = 256
#: float32 holds whole numbers up to here.
EXACT = 1 << 24
#: Bytes of the integer vectors of a run of rows.
RUN_BYTES = 32_000_000
#: Scores that are held at a time.
BLOCK_SCORES = 4_000_000
ANCHORS_A_BLOCK = 1_000


def primes_below(limit: int) -> list[int]:
    return [p for p in range(limit, 2, -1) if all(p % d for d in range(2, math.isqrt(p) + 1))]


def primes_for(bound: int, dim: int) -> list[int]:
    """Odd primes, largest first, whose product is over twice the bound and whose residues multiply exactly."""
    limit = 2 * math.isqrt(EXACT // max(1, min(dim, SLICE))) + 1
    out, product = [], 1
    for p in primes_below(limit):
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2."""
    half = p // 2
    return (x + half) % p - half


def residues(codes: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [balanced(codes, p).astype(np.float32) for p in primes]


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a times b transposed, modulo p, from float32 products of slices."""
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], SLICE):
        total += balanced((a[:, k : k + SLICE] @ b[:, k : k + SLICE].T).astype(np.int64), p)
    return balanced(total, p)


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these balanced residues, by balanced mixed-radix digits."""
    digits: list[np.ndarray] = []
    for part, p in zip(parts, primes, strict=True):
        rest, weight = part, 1
        for digit, q in zip(digits, primes, strict=False):
            rest = balanced(rest - digit * weight, p)
            weight = weight * q % p
        digits.append(balanced(rest * pow(weight, -1, p), p))
    out = np.zeros_like(parts[0])
    for digit, p in zip(reversed(digits), reversed(primes), strict=True):
        out = out * p + digit
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    return remaindered([product_mod(x, y, p) for x, y, p in zip(a, b, primes, strict=True)], primes)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integer lists as one matrix, filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Run:
    """Rows that are scored together, in the order of ids, with their residues."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, primes: list[int]):
        ids = np.concatenate([b.column("id").to_numpy() for b in batches])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.labels = np.concatenate([b.column("label").to_numpy() for b in batches])[order]
        self.parts = residues(np.concatenate([matrix(b.column("codes"), dim) for b in batches])[order], primes)
        self.repeats = bool((self.ids[1:] == self.ids[:-1]).any())
        self.of_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels).tolist()}

    def best(self, found: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        """Places in `at` (ascending) of the highest scores found there: by score, then id, each such pair once."""
        if len(at) > 4 * count and not self.repeats:
            line = np.partition(found, len(found) - count)[len(found) - count]
            kept = np.flatnonzero(found >= line)
        else:
            kept = np.arange(len(at))
        order = kept[np.argsort(-found[kept], kind="stable")]
        if self.repeats:
            ids, values = self.ids[at[order]], found[order]
            new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (values[1:] != values[:-1]))) if len(order) else []
            order = order[new]
        return order[:count]


def runs(rows: Iterator[pa.RecordBatch], dim: int, primes: list[int]) -> Iterator[Run]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in rows:
        step = max(1, RUN_BYTES // (8 * max(1, dim)))
        for k in range(0, len(batch), step):
            part = batch.slice(k, step)
            if held and size + len(part) > step:
                yield Run(held, dim, primes)
                held, size = [], 0
            held.append(part)
            size += len(part)
    if size:
        yield Run(held, dim, primes)


def anchor_blocks(address: str) -> Iterator[pa.RecordBatch]:
    """The written anchors, a bounded number at a time."""
    store, folder = store_of(address)
    names = sorted(x.path for x in store.get_file_info(stores.FileSelector(folder)) if x.path.endswith(".parquet"))
    for name in names:
        with store.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(ANCHORS_A_BLOCK)


def scored_blocks(run: Run, anchors: pa.RecordBatch, dim: int, primes: list[int], rows_of) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its number, the places in the run that rows_of(label) names, and their scores."""
    codes = residues(matrix(anchors.column("codes"), dim), primes)
    labels = anchors.column("label").to_numpy()
    for label in np.unique(labels).tolist():
        at = rows_of(label)
        mine = np.flatnonzero(labels == label)
        if not len(at):
            continue
        few = max(1, BLOCK_SCORES // len(at))
        held = [x[at] for x in run.parts] if len(at) < len(run.ids) else run.parts
        for k in range(0, len(mine), few):
            some = mine[k : k + few]
            found = scores([x[some] for x in codes], held, primes)
            yield from ((int(a), at, found[j]) for j, a in enumerate(some))


def positive_finder(address: str, dim: int, primes: list[int], count: int):
    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(rows, dim, primes):
            nothing = np.zeros(0, np.int64)
            for block in anchor_blocks(address):
                own = block.column("id").to_numpy()
                numbers = block.column("copy").to_numpy()
                out = []
                for a, at, found in scored_blocks(run, block, dim, primes, lambda x: run.of_label.get(x, nothing)):
                    other = run.ids[at] != own[a]
                    if not other.all():
                        at, found = at[other], found[other]
                    best = run.best(found, at, count)
                    out.append((np.full(len(best), own[a]), np.full(len(best), numbers[a]), run.ids[at[best]], found[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "copy", "other", "score"])

    return find


def negative_finder(address: str, dim: int, primes: list[int], count: int):
    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(rows, dim, primes):
            for block in anchor_blocks(address):
                own = block.column("id").to_numpy()
                numbers = block.column("copy").to_numpy()
                windows = block.column("windows").to_pylist()
                out = []
                for a, at, found in scored_blocks(run, block, dim, primes, lambda x: np.flatnonzero(run.labels != x)):
                    for w in windows[a]:
                        fits = np.flatnonzero((found >= w["low"]) & (found <= w["high"]))
                        best = fits[run.best(found[fits], at[fits], count)]
                        keys = (own[a], numbers[a], w["positive_id"], w["positive_score"])
                        out.append((*(np.full(len(best), x) for x in keys), run.ids[at[best]], found[best]))
                if out:
                    names = ["id", "copy", "positive_id", "positive_score", "other", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return find


def first(frame: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first rows of each key by score, then id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return frame.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def usable(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """id, label and codes of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    codes = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(F.col("id").cast("long"), F.col("label").cast("long"), codes.alias("codes"))


def limits(rows: DataFrame) -> tuple[int, int]:
    """The longest vector, and a bound of every score (the largest squared norm)."""
    square = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dim, norm = rows.agg(F.max(F.size("codes")), F.max(square)).first()
    bound = math.ceil((norm or 0.0) * (1 + 1e-9)) + 1
    if bound >= 1 << 62:
        raise ValueError("scores do not fit 62 bits: use a smaller scale")
    return max(1, dim or 0), bound


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vector: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """For each anchor and positive, the first negatives whose score is in the window below the positive's.

    rows: id, label and the vector; is_anchor: a condition on id and label. Returns anchor_id,
    positive_id, rank, negative_id, positive_score and negative_score.
    """
    folder = shared_folder(rows.sparkSession, "negatives")
    part = usable(rows, vector, scale)
    dim, bound = limits(part)
    primes = primes_for(bound, dim)
    number = F.row_number().over(Window.partitionBy("id").orderBy("label", "codes"))
    anchors = stored(part.where(is_anchor).distinct().withColumn("copy", number.cast("long")), f"{folder}/anchors")
    near = part.mapInArrow(positive_finder(f"{folder}/anchors", dim, primes, positives), "id long, copy long, other long, score long")
    near = first(near, ["id", "copy"], positives)
    # whole numbers n with low_percent * p <= 100 * n <= high_percent * p
    window = F.struct(
        F.col("other").alias("positive_id"),
        F.col("score").alias("positive_score"),
        (-F.floor(-F.col("score").cast("decimal(20,0)") * low_percent / 100)).cast("long").alias("low"),
        F.floor(F.col("score").cast("decimal(20,0)") * high_percent / 100).cast("long").alias("high"),
    )
    windows = near.groupBy("id", "copy").agg(F.collect_list(window).alias("windows"))
    stored(anchors.join(windows, ["id", "copy"]), f"{folder}/windows")
    columns = "id long, copy long, positive_id long, positive_score long, other long, score long"
    found = part.mapInArrow(negative_finder(f"{folder}/windows", dim, primes, negatives), columns)
    found = first(found, ["id", "copy", "positive_id", "positive_score"], negatives)
    return found.select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by 100 ask; every seventh id's label is moved on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), "embedding")
    return hard_negatives(rows, F.col("id") % 100 == 0)


CHECK_OP11 = """
WITH usable AS (
    SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS codes
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.codes, b.codes)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scored n USING (anchor_id)
WHERE NOT n.alike AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10
"""
