from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import hard_negatives as hn


def plainly(rows, every=100):
    """All pairs with Python's whole numbers; candidates and anchors are sets."""
    part = set()
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        part.add((i, label, tuple(math.floor(256 * x) for x in vector)))
    out = []
    for i, label, a in (x for x in part if x[0] % every == 0):
        scored = {(-sum(x * y for x, y in zip(a, b, strict=False)), j, other == label) for j, other, b in part}
        near = sorted({(s, j) for s, j, alike in scored if alike and j != i})[: hn.POSITIVES]
        far = sorted({(s, j) for s, j, alike in scored if not alike})
        for p, j in near:
            fits = [(s, k) for s, k in far if 30 * -p <= 100 * -s <= 90 * -p][: hn.NEGATIVES]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fits, 1)]
    return sorted(set(out))


def mined(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, 9, 8) for r in rows], "id long, label int, embedding array<double>, score int, copy int")
    return sorted(tuple(r) for r in hn.hard_negatives(frame.repartition(parts), F.col("id") % 100 == 0).distinct().collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [round(rng.gauss(0.2, 0.4), 2) for _ in range(5)]) for i in range(600)]
    assert mined(spark, rows) == plainly(rows)


def test_ties_nulls_repeats_and_odd_vectors(spark):
    rng = random.Random(3)
    hot = [0.5, 0.25, -0.125]
    rows = [(i, i % 3, hot) for i in range(250)]  # one vector for all: ties only
    rows += [(i, i % 3, [rng.random() for _ in range(3)]) for i in range(250, 400)]
    rows += [(0, 0, hot), (0, 1, hot), (100, 1, [0.1]), (300, 0, []), (7, 0, hot), (7, 2, [0.9, 0.9, 0.9])]
    rows += [(None, 1, hot), (500, None, hot), (501, 1, None), (502, 1, [0.1, None, 0.2])]
    rows += [(600, 1, [math.nan, 0.0, 0.0]), (601, 1, [math.inf, 0.0, 0.0]), (-100, 2, [0.4, 0.5]), (700, 1, [-1.0, -1.0, -1.0])]
    assert mined(spark, rows) == plainly(rows)


def test_runs_and_blocks_of_any_size_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.randint(0, 3) / 4 for _ in range(3)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, label long, embedding array<double>")
    wanted = plainly(rows)
    batches = hn.usable(frame, "embedding", 256).toArrow().combine_chunks().to_batches(max_chunksize=70)
    for size in (24, 24 * 40, 24 * 10_000):
        monkeypatch.setattr(hn, "RUN_BYTES", size)
        sizes = [len(r.ids) for r in hn.runs(iter(batches), 3, [7])]
        assert sum(sizes) == 500 and max(sizes) <= max(1, size // 24)
    monkeypatch.setattr(hn, "BLOCK_SCORES", 50)
    assert mined(spark, rows, 7) == wanted


@pytest.mark.parametrize("dim", [1, 3, 64, 300, 700])
def test_scores_are_exact(dim):
    rng = np.random.default_rng(dim)
    for size in (3, 148, 40_000, 3_000_000):
        a, b = (rng.integers(-size, size + 1, (4, dim)) for _ in range(2))
        a[0], b[0], b[1] = size, size, -size
        primes = hn.primes_for(dim * size * size, dim)
        assert math.prod(primes) > 2 * dim * size * size
        assert (primes[0] // 2) ** 2 * min(dim, hn.SLICE) <= hn.EXACT
        found = hn.scores(hn.residues(a, primes), hn.residues(b, primes), primes)
        assert found.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]


def test_scores_beyond_a_long_are_refused(spark):
    rows = spark.createDataFrame([(100, 1, [1e18]), (1, 1, [1e18])], "id long, label long, embedding array<double>")
    with pytest.raises(ValueError, match="62 bits"):
        hn.hard_negatives(rows, F.col("id") % 100 == 0)


def test_empty_tables(spark):
    kinds = "id long, label int, embedding array<float>"
    frames = [spark.createDataFrame(x, kinds) for x in ([], [(100, 1, None)], [(100, 1, [0.5])], [(100, 1, []), (1, 1, []), (2, 0, [])])]
    found = [sorted(map(tuple, hn.hard_negatives(f, F.col("id") % 100 == 0).collect())) for f in frames]
    assert found == [[], [], [], [(100, 1, 1, 2, 0, 0)]]
