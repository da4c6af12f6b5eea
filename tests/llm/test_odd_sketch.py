from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paceline.llm import odd_sketch as odd
from paceline.llm.common import table
from tests.conftest import SF_DIR


def shingles(text: str | None, size: int = 2) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def plainly(rows, percent=80, size=2):
    """doc_id, n_shingles, component_id, kept of every row, all pairs of sets compared."""
    sets = [shingles(t, size) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    parent = list(range(len(kinds)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, x in enumerate(kinds):
        for j in range(i):
            y = kinds[j]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or root(i) == root(j):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[root(i)] = root(j)
    place = {s: k for k, s in enumerate(kinds)}
    least: dict = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            k = root(place[s])
            least[k] = min(i, least.get(k, i))
    named = [i if not s else least.get(root(place[s])) for (i, _), s in zip(rows, sets, strict=True)]
    return sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, named, strict=True)), key=repr)


def found(frame):
    assert frame.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def variants(rng, count, length, edits):
    """Texts of one origin: chains of edits, so that ends of a chain differ more than neighbours."""
    words = [f"w{rng.randrange(5_000)}" for _ in range(length)]
    out = []
    for _ in range(count):
        for _ in range(edits):
            words[rng.randrange(length)] = f"w{rng.randrange(5_000)}"
        out.append(" ".join(words))
    return out


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    assert found(odd.op12_minhash_near_dedup(spark, SF_DIR)) == plainly(rows)


@pytest.mark.parametrize(("crowd", "block", "pivots"), [(2, 7, 1), (16, 256, 4), (4, 50, 2)])
def test_crowds_lose_no_link(spark, documents, monkeypatch, crowd, block, pivots):
    monkeypatch.setattr(odd, "PIVOTS", pivots)
    rng = random.Random(crowd)
    texts = variants(rng, 120, 100, 4) + variants(rng, 60, 300, 25) + variants(rng, 40, 12, 1)
    base = " ".join(f"c{k}" for k in range(200)).split()
    for _ in range(150):  # a template: all share buckets, about half of them links
        words = list(base)
        for k in rng.sample(range(200), rng.randint(5, 14)):
            words[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += texts[::7]
    rows = [(i * 3, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    frame = documents([(i, t, None) for i, t in rows]).repartition(6)
    assert found(odd.near_duplicates(frame, crowd=crowd, block=block)) == plainly(rows)


@pytest.mark.parametrize("long", [1 << 20, 2_000])
def test_a_crowd_just_below_the_similarity_gives_no_candidates(spark, documents, monkeypatch, long):
    monkeypatch.setattr(odd, "BLOCK_SHINGLES", long)
    rng, base, made = random.Random(5), [f"c{k}" for k in range(200)], {}
    texts = []
    for k in range(160):  # any two have about 171 of 227 shingles in common, but for one and its copy
        words = list(base)
        for place in rng.sample(range(1, 199, 2), 7):
            words[place] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(words)] + [" ".join([*words, "more"])] * (k % 40 == 0)
    rows = list(enumerate(texts))
    plain = odd.stored

    def counted(frame, address):
        out = plain(frame, address)
        if "/crowds/" in address:
            made[address.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(odd, "stored", counted)
    assert found(odd.near_duplicates(documents([(i, t, None) for i, t in rows]).repartition(4))) == plainly(rows)
    keys = odd.band_keys(odd.minima(odd.shingle_sets(pa.array(texts), 2))).ravel().tolist()
    held = Counter(n for n in Counter(keys).values() if n > odd.CROWD)
    assert made["asked"] > 0
    if long > 2_000:  # one block: no more rows than there are places in crowded buckets
        assert sum(made.values()) <= sum(n * k for n, k in held.items())


def test_blocks_give_links_only():
    base = [f"c{k}" for k in range(200)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join(base[:150])]
    sets = odd.shingle_sets(pa.array(texts), 2)
    least = odd.minima(sets)
    group = pa.table(
        {
            "key": odd.band_keys(least)[0, :1].repeat(3), "kind": ["rest"] * 3, "i": [0] * 3, "j": [0] * 3, "own": [0] * 3, "in_rest": [True] * 3,
            "n": [len(x) for x in sets], "node": [10, 11, 12], "comp": [10, 11, 12], "sketch": odd.odd_sketches(least).tolist(),
            "bands": odd.band_keys(least)[[0, 0, 0]].tolist(), "text": texts,
        }
    )
    assert odd.block_asked(80)(group.drop_columns(["text"])).column("node").to_pylist() == [10, 11]
    assert odd.block_links(2, 80)(group).to_pylist() == [{"a": 11, "b": 10}]
    assert odd.block_links(2, 100)(group).num_rows == 0


def test_other_shingles_and_similarity(spark, documents):
    rng = random.Random(8)
    rows = list(enumerate(variants(rng, 80, 60, 1)))
    frame = documents([(i, t, None) for i, t in rows])
    assert found(odd.near_duplicates(frame, shingle=3, percent=90)) == plainly(rows, 90, 3)


def test_nulls_repeats_and_foreign_columns(odd_rows, odd_frame):
    assert found(odd.near_duplicates(odd_frame)) == [(*r[:3], r[0] == r[2]) for r in plainly(odd_rows)]


@pytest.fixture
def odd_rows():
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [(1, text), (2, None), (3, ""), (5, text.upper()), (5, text.upper()), (5, text), (4, "one"), (6, "ONE\n"), (None, text)]
    rows += [(None, "only without an id here"), (None, None), (7, " \t\r\n\x0b\x0c"), (8, "a b\x1c c　d"), (9, "é É"), (10, "É é")]
    return rows + [(11, "long words here " * 30_000), (12, "long words here " * 30_000), (-4, text + " so"), (13, text)] * 2


@pytest.fixture
def odd_frame(documents, odd_rows):
    return documents([(i, t, None) for i, t in odd_rows]).repartition(4)


def test_empty_table(none):
    assert odd.near_duplicates(none).count() == 0


def test_sets_are_those_of_plain_python():
    texts = ["a b c a b", None, "", "one", " x  y\tz\n", "A a", "é\x1cü b", "the the the the"]
    sets = odd.shingle_sets(pa.array(texts), 2)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert set(odd.shingle_sets(pa.array(["a b", "A B", "b a", "ab", "a"]), 2)[0]) == set(odd.shingle_sets(pa.array(["A\tB"]), 2)[0])


def test_sketches_estimate_similarity_and_the_limit_holds():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 4_000_000, dtype=np.uint64)
    bits = {}
    for share in (0.9, 0.8, 0.5):
        both = int(1000 * share)
        only = (1000 - both) // 2  # union of 1000
        d = []
        for k in range(300):
            x = pool[k * 1000 : (k + 1) * 1000]
            pair = [np.unique(x[: both + only]), np.unique(np.concatenate((x[:both], x[both + only :])))]
            a, b = odd.odd_sketches(odd.minima(pair)).view(np.uint64)
            d.append(int(np.bitwise_count(a ^ b).sum()))
        bits[share] = np.array(d)
        estimate = 1 + odd.BITS / (4 * odd.SAMPLES) * np.log(1 - 2 * bits[share].mean() / odd.BITS)
        assert abs(estimate - share) < 0.02
    assert bits[0.8].max() <= odd.most_bits(80)
    assert (bits[0.8] > odd.most_bits(80, 0.5)).mean() == pytest.approx(0.5, abs=0.15)
    assert (bits[0.5] > odd.most_bits(80)).mean() > 0.99


def test_blocks_give_the_closest_pairs_of_a_node_first(monkeypatch):
    monkeypatch.setattr(odd, "MORE_PAIRS", 2)
    sketch = [[(1 << k) - 1, *[0] * (odd.WORDS - 1)] for k in range(6)]
    group = pa.table(
        {
            "key": [7] * 6, "kind": ["main"] * 6, "i": [0] * 6, "j": [0] * 6, "own": [0] * 6, "in_rest": [True] + [False] * 5, "n": [10] * 6,
            "node": [10, 11, 12, 20, 21, 22], "comp": [1, 2, 2, 2, 2, 2], "now": [1, 2, 2, 2, 2, 2], "sketch": sketch,
            "bands": [[k, 7, 0] for k in (1, 2, 3, 4, 1, 5)],
        }
    )
    turns = [odd.block_pairs(80, t)(group).to_pylist() for t in range(3)]
    # 21 meets 10 in an earlier band as well
    assert [[(r["a"], r["b"]) for r in t] for t in turns] == [[(11, 10)], [(12, 10), (20, 10)], [(22, 10)]]
    assert [{r["more"] for r in t} for t in turns] == [{True}, {True}, {False}]
    joined = group.set_column(group.schema.get_field_index("now"), "now", pa.array([1] * 6))
    assert odd.block_pairs(80, 1)(joined).num_rows == 0


def test_slices_of_a_batch_give_the_same_sets(monkeypatch):
    rng = random.Random(2)
    texts = [None if k % 9 == 0 else " ".join(rng.choices(["Äpfel", "naïve", "a", "b", "日本", "x\x85y"], k=k % 30)) for k in range(200)]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"])
        for size in (1, 50, 1_000):
            monkeypatch.setattr(odd, "SLICE_BYTES", size)
            parts = list(odd.slices(iter([batch.slice(3), batch.slice(0, 3)]), "text"))
            sets = [s for part in parts for s in odd.shingle_sets(part.column("text"), 2)]
            assert [len(s) for s in sets] == [len(shingles(t)) for t in texts[3:] + texts[:3]]
            whole = odd.shingle_sets(batch.column("text"), 2)
            assert all((a == b).all() for a, b in zip(sets, whole[3:] + whole[:3], strict=True))
