"""Document fingerprints by prefix polynomial hashes.

A text's prefix array holds, for each length, the hash of that many first code points
(sum of code point times base to its place, modulo a prime, for two bases). From two
arrays any two spans are compared in constant time, and the longest common extension of
two places is found by binary search. The fingerprint written out is the number of code
points and the whole text's hash, and tells equal texts; likeness is taken from the arrays
themselves.

The likeness of two texts is the share of the longer one that common spans cover, in order:
the common beginning, the common end, and between them spans found from anchors. An anchor
is a block of BLOCK code points of the first text, at a multiple of BLOCK, whose hash is
that of a window of the second one, the first after the span before it; by common
extensions it grows to both sides. So a span in common of 2 * BLOCK - 1 code points or more
holds a block, whatever was changed before it.

The query also needs each document's successor by doc_id. Documents are dealt out by
ranges of ids, each range is read in order, and the first document of a range is sent
to the range before it as well (that of the first range to the last one).

A null text is an empty one. A null doc_id comes first; equal ids go by text. A table of
one row has that row as its own successor; an empty table gives no row. Two empty texts
are alike (1). Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import partitions, table

PRIME = (1 << 31) - 1
BASES = (1_000_003, 805_306_457)
BLOCK = 32
LEAST_ID = -(1 << 63)
ROWS = 2000
_powers = [np.ones(1, np.uint64) for _ in BASES]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers (at least) of each base; kept by the process, doubled as needed."""
    while len(_powers[0]) < n:
        for k, base in enumerate(BASES):
            now = _powers[k]
            step = np.uint64(pow(base, len(now), PRIME))
            _powers[k] = np.concatenate((now, now * step % np.uint64(PRIME)))
    return _powers


@dataclass
class Prefixes:
    """Prefix hashes of a text: arrays of one more than its code points, one for each base."""

    n: int
    arrays: list[np.ndarray]

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        n, arrays = len(codes), []
        for power in powers(len(codes) + 1):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes * power[:n] % np.uint64(PRIME), out=sums[1:])
            arrays.append(sums % np.uint64(PRIME))
        return cls(n, arrays)

    def joined(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """Of the first `keep` code points and the first `take` of another text."""
        arrays = []
        for mine, its, power in zip(self.arrays, other.arrays, powers(keep + 1), strict=True):
            tail = (mine[keep] + its[1 : take + 1] * power[keep]) % np.uint64(PRIME)
            arrays.append(np.concatenate((mine[: keep + 1], tail)))
        return Prefixes(keep + take, arrays)

    def same(self, at: int, other: Prefixes, there: int, size: int) -> bool:
        """Whether the spans of `size` code points at the two places are equal."""
        for mine, its, power in zip(self.arrays, other.arrays, powers(max(at, there) + 1), strict=True):
            a = (int(mine[at + size]) - int(mine[at])) * int(power[there])
            b = (int(its[there + size]) - int(its[there])) * int(power[at])
            if (a - b) % PRIME:
                return False
        return True

    def extension(self, at: int, other: Prefixes, there: int, back: bool = False, limit: int | None = None) -> int:
        """Longest common extension of two places, forward, or back from their ends; at most `limit`."""
        low, high = 0, min(at, there) if back else min(self.n - at, other.n - there)
        high = high if limit is None else min(high, limit)
        while low < high:
            size = (low + high + 1) // 2
            if self.same(at - size * back, other, there - size * back, size):
                low = size
            else:
                high = size - 1
        return low

    def text(self) -> str:
        return f"{self.n:x}-" + "".join(f"{int(x[-1]):08x}" for x in self.arrays)

    def likeness(self, other: Prefixes) -> float:
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        if not longer:
            return 1.0
        head = self.extension(0, other, 0)
        tail = min(shorter - head, self.extension(self.n, other, other.n, back=True))
        return (head + tail + self.between(other, head, tail)) / longer

    def windows(self, starts: np.ndarray, top: int) -> np.ndarray:
        """Hashes of the BLOCK code points at the places, as if all began at place `top`; both bases in one number."""
        out = np.zeros(len(starts), np.uint64)
        for mine, power in zip(self.arrays, powers(top + 1), strict=True):
            span = (mine[starts + BLOCK] + np.uint64(PRIME) - mine[starts]) % np.uint64(PRIME)
            out = (out << np.uint64(31)) | (span * power[top - starts] % np.uint64(PRIME))
        return out

    def between(self, other: Prefixes, head: int, tail: int) -> int:
        """Code points of spans in common, in order, after the first `head` and before the last `tail`."""
        end, its_end = self.n - tail, other.n - tail
        starts = np.arange(-(-head // BLOCK) * BLOCK, end - BLOCK + 1, BLOCK)
        places = np.arange(head, its_end - BLOCK + 1)
        if not len(starts) or not len(places):
            return 0
        top = max(self.n, other.n)
        known, which = np.unique(self.windows(starts, top), return_inverse=True)
        found = other.windows(places, top)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        order = np.argsort(at[hit], kind="stable")
        at, places = at[hit][order], places[hit][order]  # places of each known block, ascending
        first, last = np.searchsorted(at, np.arange(len(known)), "left"), np.searchsorted(at, np.arange(len(known)), "right")
        mine, its, covered = head, head, 0
        for k in np.flatnonzero(last[which] > first[which]).tolist():
            start, block = int(starts[k]), which[k]
            if start < mine:
                continue
            next_ = first[block] + int(np.searchsorted(places[first[block] : last[block]], its))
            if next_ == last[block]:
                continue
            there = int(places[next_])
            back = self.extension(start, other, there, back=True, limit=min(start - mine, there - its))
            on = self.extension(start, other, there, limit=min(end - start, its_end - there))
            covered += back + on
            mine, its = start + on, there + on
        return covered


SHAPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = [x.split()[0] for x in SHAPE.split(", ")]


def compare(doc_id: int | None, text: str, own: Prefixes, after: str, its: Prefixes) -> tuple:
    keep = own.n - own.n // 2
    take = min(own.n // 2, its.n)
    edited = own.joined(keep, its, take)
    digest = hashlib.sha256((text[:keep] + after[:take]).encode(errors="surrogatepass")).hexdigest()
    return doc_id, own.n, digest, own.text(), edited.text(), own.likeness(edited), own.likeness(its)


def compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ahead, doc_id, text) in order; one row for each that is not ahead."""
    out: list[tuple] = []
    held: tuple | None = None  # the document whose successor comes next
    for batch in rows:
        for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ahead and (held is None or held[0] != part):
                continue
            own = Prefixes.of(text)
            if held is not None and held[0] == part:
                out.append(compare(*held[1:], text, own))
            held = None if ahead else (part, doc_id, text, own)
            if len(out) >= ROWS:
                yield made(out)
                out = []
    if out:
        yield made(out)


def made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of the text made of it and its successor."""
    spark = docs.sparkSession
    n = partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = docs.select(
        key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    shares = [k / n for k in range(1, n)]
    cuts = rows.agg(F.percentile_approx("key", shares or [0.5], 100 * n)).first()[0] or []
    bounds = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<long>")
    rows = rows.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("key"))))
    # one row for each range
    firsts = sorted(tuple(x) for x in rows.groupBy("range").agg(F.min("key")).collect())
    to = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    targets = F.broadcast(spark.createDataFrame(to, "key long, target int"))
    ahead = rows.join(targets, "key").select(F.col("target").alias("range"), F.lit(1).alias("ahead"), "doc_id", "text", "key")
    both = rows.select("range", F.lit(0).alias("ahead"), "doc_id", "text", "key").unionByName(ahead)
    dealt = both.repartitionByRange(n, "range").sortWithinPartitions("range", "ahead", "key", "text")
    return dealt.select("range", "ahead", "doc_id", "text").mapInArrow(compared, SHAPE)


def op9_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
