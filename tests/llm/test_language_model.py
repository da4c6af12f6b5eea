from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from paceline.llm import language_model as lm
from paceline.llm.common import shared_folder, table
from tests.conftest import SF_DIR


def split(text):
    return (text or "").encode().lower().split()


def arrays(texts, numbers):
    return lm.run_arrays([np.array([numbers[w] for w in split(t)], np.int64) for t in texts])


LETTERS = {bytes([97 + k]): 5 + 37 * k for k in range(26)}


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in lm.start_weights().items()}
    padded, places, _ = arrays(["a b c d e f a b c", None, "x y z a"], LETTERS)
    found = lm.gradient(weights, padded, places)
    for k, shape in lm.SHAPES.items():
        at = tuple(rng.integers(s) for s in shape)
        if k == "words":
            at = (int(padded[places[0]]), at[1])
        weights[k][at] += 1e-5
        up = -lm.log_chances(weights, padded, places).mean()
        weights[k][at] -= 2e-5
        down = -lm.log_chances(weights, padded, places).mean()
        weights[k][at] += 1e-5
        assert found[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_words_are_those_of_plain_python():
    texts = ["A b\tc  b ", "", "é\x1cÉ ü", " x\n\n", "\x0b\x0c"]
    words, codes, sizes = lm.coded(texts)
    assert sizes.tolist() == [len(split(t)) for t in texts]
    assert [words[c] for c in codes] == [w for t in texts for w in split(t)]


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def gathered(spark):
    """Numbers, shares and trained weights of the small table."""
    docs = table(spark, SF_DIR, "documents")
    folder = shared_folder(spark, "test")
    words = lm.numbered(docs, folder)
    counts = spark.read.parquet(f"{folder}/counts")
    numbers = lm.vocabulary(counts)
    found = {bytes(r.word): r.total for r in counts.collect()}
    number, log_share = lm.log_shares(list(found), np.array(list(found.values())), numbers, lm.number_totals(counts, numbers))
    shares = {w: (int(k), float(x)) for w, k, x in zip(found, number, log_share, strict=True)}
    return numbers, shares, lm.shaped(lm.train(words))


def test_every_word_of_the_corpus_is_counted(corpus, gathered):
    numbers, shares, _ = gathered
    counts = Counter(w for _, t in corpus for w in split(t))
    top = sorted((w for w in counts if len(w) <= lm.LONGEST), key=lambda w: (-counts[w], w))[: lm.WORDS - lm.SHARED - 1]
    assert numbers == {w: k + 1 for k, w in enumerate(top)}
    number = {w: numbers.get(w, lm.WORDS - lm.SHARED + zlib.crc32(w[-3:]) % lm.SHARED) for w in counts}
    sums = Counter()
    for w, n in counts.items():
        sums[number[w]] += n
    assert shares.keys() == counts.keys() and len(counts) > lm.WORDS
    for w, n in counts.items():
        found, log_share = shares[w]
        assert found == number[w]
        assert log_share == pytest.approx(math.log(n / (sums[found] + (w not in numbers))), abs=1e-12)


def test_chances_of_all_words_and_the_reserve_sum_to_one(gathered):
    _, shares, weights = gathered
    padded, places, _ = arrays(["a b c d e"], LETTERS)
    chance = np.zeros(lm.WORDS)
    for k in range(lm.WORDS):
        swapped = padded.copy()
        swapped[places[2]] = k
        chance[k] = np.exp(lm.log_chances(weights, swapped, places)[2])
    assert chance.sum() == pytest.approx(1.0, abs=1e-4)
    share = np.zeros(lm.WORDS)
    for number, log_share in shares.values():
        share[number] += math.exp(log_share)
    used = sorted({n for n, _ in shares.values()})
    shared = [n for n in used if n >= lm.WORDS - lm.SHARED]
    assert np.allclose(share[[n for n in used if n not in shared]], 1) and all(0.9 < share[n] < 1 for n in shared)


def plain_score(weights, numbers, context_of):
    """The network in plain Python floats."""
    total = 0.0
    for at, word in enumerate(numbers):
        given = []
        for k in (-2, -1, 1, 2):
            near = numbers[at + k] if 0 <= at + k < len(numbers) else 0
            given += weights["words"][near].tolist()
        hidden = [
            math.tanh(sum(g * weights["input"][i][j].item() for i, g in enumerate(given)) + weights["input_bias"][j].item()) for j in range(lm.HIDDEN)
        ]
        for name, bias, place in (("classes", weights["class_bias"], word // lm.SIDE), ("within", weights["within_bias"][word // lm.SIDE], word % lm.SIDE)):
            out = [sum(h * weights[name][i][j].item() for i, h in enumerate(hidden)) + bias[j].item() for j in range(lm.SIDE)]
            top = max(out)
            total += out[place] - top - math.log(sum(math.exp(x - top) for x in out))
    return total + sum(context_of)


def test_scores_against_plain_python(spark, corpus, gathered):
    _, shares, weights = gathered
    rows = {r.doc_id: r for r in lm.op8_lm_scoring(spark, SF_DIR).collect()}
    assert sorted((r.doc_id, r.n_words) for r in rows.values()) == sorted((i, len(split(t))) for i, t in corpus)
    assert all(r.log_likelihood <= 0 and r.mean_log_likelihood == pytest.approx(r.log_likelihood / r.n_words) for r in rows.values())
    short = sorted((t, i) for i, t in corpus if 3 < len(split(t)) < 60)[:6]
    for text, doc_id in short:
        found = [shares[w] for w in split(text)]
        wanted = plain_score(weights, [n for n, _ in found], [s for _, s in found])
        assert rows[doc_id].log_likelihood == pytest.approx(wanted, rel=1e-3)


def test_rare_words_score_below_frequent_ones_of_their_number_and_copies_apart(spark, documents):
    rng = random.Random(5)
    common = [f"w{k:03d}" for k in range(1_200)]
    texts = [" ".join(rng.choices(common, k=200)) for _ in range(200)]
    once = " ".join(f"xq{k}zed" for k in range(80))
    twice = " ".join(f"yq{k}zed" for k in range(80))
    often = " ".join(f"vq{k}zed" for k in range(80))
    rows = [(k, t, None) for k, t in enumerate([*texts, once, *[twice] * 2, *[often] * 8])]
    mean = {r.doc_id: r.mean_log_likelihood for r in lm.score(documents(rows)).collect()}
    assert mean[200] < mean[201] - 0.5 and mean[201] == pytest.approx(mean[202]) and mean[202] < mean[203] - 1


def test_order_counts(spark):
    docs = table(spark, SF_DIR.replace("0.001", "0.01"), "documents")
    folder = shared_folder(spark, "test")
    weights = lm.shaped(lm.train(lm.numbered(docs, folder)))
    counts = spark.read.parquet(f"{folder}/counts")
    own = lm.vocabulary(counts)
    numbers = {bytes(r.word): lm.number_of(bytes(r.word), own) for r in counts.collect()}
    texts = [r.text for r in docs.where("lang = 'en'").limit(100).collect()]
    rng = random.Random(1)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts]
    mean = lambda x, w=weights: lm.log_chances(w, *arrays(x, numbers)[:2]).mean()
    assert mean(texts) > mean(texts, lm.start_weights()) + 1
    assert mean(texts) > mean(mixed)


def test_runs_of_any_size_give_the_same_numbers(spark, corpus, monkeypatch):
    frame = spark.createDataFrame(corpus[:60], "doc_id long, text string").coalesce(1)
    batch = frame.toArrow().combine_chunks().to_batches()
    wanted = None
    for size in (100, 100_000_000):
        monkeypatch.setattr("paceline.llm.binary_records.BATCH_CHARS", size)
        made = [b for b in lm.code(iter(batch))]
        found = Counter()
        for b in made:
            rows = b.to_pylist()
            words = rows[-1]["words"]
            for r in rows[:-1]:
                found[r["doc_id"], tuple(words[c] for c in np.frombuffer(r["codes"], "<i4"))] += 1
            assert sum(rows[-1]["counts"]) == sum(len(r["codes"]) // 4 for r in rows[:-1])
        wanted = wanted or found
        assert found == wanted and (len(made) > 1) == (size == 100)


def test_nulls_repeats_and_empty_tables(odd, none):
    rows = {r.doc_id: r for r in lm.score(odd).collect()}
    assert lm.score(odd).count() == odd.count()
    assert (rows[2].n_words, rows[2].log_likelihood, rows[2].mean_log_likelihood) == (0, 0.0, None)
    assert rows[4].n_words == 80_000 and rows[None].n_words > 0
    assert lm.score(none).count() == 0


def test_narrow_runs_hold_the_same_words_in_half_the_bytes(spark, corpus):
    frame = spark.createDataFrame(corpus[:60], "doc_id long, text string").coalesce(1)
    batch = frame.toArrow().combine_chunks().to_batches()
    for wide, narrow in zip(lm.code(iter(batch)), lm.code(iter(batch), narrow=True), strict=True):
        assert wide.column("words") == narrow.column("words") and wide.column("counts") == narrow.column("counts")
        for x, y in zip(wide.column("codes").to_pylist()[:-1], narrow.column("codes").to_pylist()[:-1], strict=True):
            assert 2 * len(y) == len(x) and (np.frombuffer(x, "<i4") == np.frombuffer(y, "<u2")).all()
        ends = narrow.column("ends")[-1].as_py()
        assert [lm.WORDS - lm.SHARED + k for k in ends] == [lm.number_of(w, {}) for w in narrow.column("words")[-1].as_py()]
    assert lm.width(1 << 16) == "<u2" and lm.width((1 << 16) + 1) == "<i4"
