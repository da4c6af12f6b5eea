from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from paceline.llm import simhash
from paceline.llm.common import shared_folder, table
from tests.conftest import SF_DIR


def fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[tuple]) -> dict:
    """Smallest id of each fingerprint's component, all pairs compared."""
    found = sorted({p for _, p in prints})
    parent = {p: p for p in found}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(found):
        for b in found[:k]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least: dict = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return {p: least.get(root(p)) for p in found}


def test_query_against_all_pairs(spark):
    prints = [(r.doc_id, fingerprint(r.text)) for r in table(spark, SF_DIR, "documents").collect()]
    component = groups(prints)
    rows = simhash.op2_simhash_near_dedup(spark, SF_DIR).collect()
    assert sorted(map(tuple, rows)) == sorted((i, f"{p:016x}", component[p]) for i, p in prints)


@pytest.mark.parametrize("crowd", [0, 5, 64])
def test_crowded_halves_lose_no_link(spark, crowd):
    rng = random.Random(3)
    prints = []
    for i in range(400):
        p = 0x123456789ABCDEF0 if i < 300 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            p ^= 1 << rng.choice([1, 3, 5, 9, 12, 14, 17, 20, 25, 30, 31, 32, 33, 40, 50, 63])
        prints.append((i, p))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints]
    frame = spark.createDataFrame(signed, "doc_id long, simhash long")
    rows = simhash.near_groups(frame, shared_folder(spark, "test"), crowd).collect()
    component = groups(prints)
    assert {r.doc_id: r.component_id for r in rows} == {i: component[p] for i, p in prints}


def test_nulls_repeats_and_foreign_columns(odd):
    prints = [(r.doc_id, fingerprint(r.text)) for r in odd.select("doc_id", "text").collect()]
    component = groups(prints)
    rows = simhash.simhash_groups(odd).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, rows), key=key) == sorted(((i, f"{p:016x}", component[p]) for i, p in prints), key=key)


def test_empty_table(none):
    assert simhash.simhash_groups(none).count() == 0


def test_spark_hash_is_the_same_function(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()
    assert row[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)
