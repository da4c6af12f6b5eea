from __future__ import annotations

import random

import numpy as np
import pytest

from paceline.llm import decontamination as deco
from paceline.llm.common import table
from tests.conftest import SF_DIR


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for k, y in enumerate(b):
            old, row[k + 1] = row[k + 1], old + 1 if x == y else max(row[k], row[k + 1])
    return row[-1]


def test_bit_parallel_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 40))])
        b = np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 80))])
        assert deco.common_subsequence(a, b) == subsequence(a.tolist(), b.tolist())


def test_query_finds_every_whole_passage(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    items = table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()
    planted = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in (d.text or "")}
    found = {(r.doc_id, r.item_id) for r in deco.op5_benchmark_decontamination(spark, SF_DIR).collect()}
    assert planted and found == planted


def test_space_of_the_distributed_svd(spark):
    rng = np.random.default_rng(1)
    matrix = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    rows = [(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in matrix]
    space = deco.latent_space(spark, rows, 12, 4)
    _, _, wanted = np.linalg.svd(matrix)
    assert np.abs(np.abs(space.T @ wanted[:4].T) - np.eye(4)).max() < 0.05


@pytest.fixture(scope="module")
def planted(spark, documents):
    rng = random.Random(2)
    items = [words(rng, n) for n in (9, 15, 30, 60, 150)]
    hot = words(rng, 400)
    texts = {k: words(rng, rng.randint(0, 300)) for k in range(60)}
    leaks = set()
    for k, item in enumerate(items):
        cut = words(rng, 70), words(rng, 90)
        texts[100 + k] = f"{cut[0]} {item.upper()}. {cut[1]}"
        kept = [w for j, w in enumerate(item.split()) if j % 6 != 5]  # a paraphrase: words left out and put in
        texts[200 + k] = f"{cut[1]} {' '.join(w if j % 5 else w + ' also' for j, w in enumerate(kept))} {cut[0]}"
        leaks |= {(100 + k, k), (200 + k, k)}
    rows = [(k, t, "en") for k, t in texts.items()] + [(900 + k, hot, "en") for k in range(40)]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    return documents(rows), benchmark, leaks


def test_copies_and_paraphrases_are_found_and_nothing_else(planted):
    docs, benchmark, leaks = planted
    for block in (4000, 3):
        found = deco.contamination(docs, benchmark, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == leaks
        assert len(found) == len(leaks)


def test_a_wrong_answer_clears_a_weak_match(spark, documents):
    rng = random.Random(3)
    item = words(rng, 40)
    weak = " ".join(w for k, w in enumerate(item.split()) if k % 4)  # three quarters of the words
    docs = documents([(1, weak, "en"), (2, item, "en")] + [(k, words(rng, 50), "en") for k in range(3, 30)])
    for answer, ids in ((item.split()[5], {1, 2}), ("never said", {2})):
        benchmark = spark.createDataFrame([(1, item, answer)], "item_id long, text string, answer string")
        assert {r.doc_id for r in deco.contamination(docs, benchmark).collect()} == ids


def test_whole_copies_are_found_among_thousands_of_items(spark, documents):
    """Far more passages than the rank of a latent space."""
    rng = random.Random(4)
    items = [words(rng, rng.randint(15, 59)) for _ in range(1500)]
    leaks = rng.sample(range(len(items)), 150)
    docs = documents([(k, f"{words(rng, 40)} {items[k]} {words(rng, 40)}", "en") for k in leaks])
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in deco.contamination(docs, benchmark).collect()}
    assert found == {(k, k) for k in leaks}


def test_nulls_repeats_and_empty_tables(spark, odd, none):
    one = spark.createDataFrame([(1, "The same text again and again, with 1234 numbers")], "item_id long, text string")
    found = deco.contamination(odd, one).collect()
    assert sorted(r.doc_id for r in found) == sorted([1, 5, 5, *range(100, 130)])
    assert deco.contamination(none, one).count() == 0
    assert deco.contamination(odd, one.limit(0)).count() == 0
