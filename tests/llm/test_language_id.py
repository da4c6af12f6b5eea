from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pytest

from paceline.llm import language_id as lang
from paceline.llm.common import table
from tests.conftest import SF_DIR


def test_marginals_against_all_label_sequences():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 1, 4, 2])
    scores, moves = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(3, 3))
    found = lang.marginals(scores.astype(np.float32), sizes, moves)
    at = 0
    for n in sizes:
        wanted = np.zeros((n, 3))
        for labels in product(range(3), repeat=int(n)):
            weight = np.exp(sum(scores[at + t, y] for t, y in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            for t, y in enumerate(labels):
                wanted[t, y] += weight
        assert np.allclose(found[at : at + n], wanted / wanted.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    scores, moves, labels = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))

    def loss(s, m):
        total = 0.0
        for c in range(2):
            every = [sum(s[c, t, y] for t, y in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])) for p in product(range(3), repeat=4)]
            own = labels[c]
            total += np.log(np.exp(every).sum()) - sum(s[c, t, y] for t, y in enumerate(own)) - sum(m[a, b] for a, b in zip(own, own[1:]))
        return total

    by_scores, by_moves = lang.chain_gradient(scores, labels, moves)
    for at in [(0, 0, 0), (1, 2, 1), (0, 3, 2)]:
        step = np.zeros_like(scores)
        step[at] = 1e-5
        assert by_scores[at] == pytest.approx((loss(scores + step, moves) - loss(scores - step, moves)) / 2e-5, abs=1e-4)
    for at in [(0, 1), (2, 2)]:
        step = np.zeros_like(moves)
        step[at] = 1e-5
        assert by_moves[at] == pytest.approx((loss(scores, moves + step) - loss(scores, moves - step)) / 2e-5, abs=1e-4)


def test_features_do_not_depend_on_the_place():
    def at(text):
        found, n = lang.features(text)
        return [sorted(place[word == n - 1].tolist()) for word, place in found]

    assert at("hello") == at("some other words, then Hello!") and at("hello") != at("hallo")


@pytest.fixture(scope="module")
def field(spark):
    return lang.learn(table(spark, SF_DIR, "documents"))


def test_held_out_documents_are_told(spark, field):
    rows = lang.op4_language_id(spark, SF_DIR).collect()
    docs = {r.doc_id: r for r in table(spark, SF_DIR, "documents").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.lang_pred == docs[r.doc_id].lang for r in held if docs[r.doc_id].lang]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_switched_text_has_a_share_of_each_language(spark, field):
    docs = table(spark, SF_DIR, "documents").where("length(text) > 900").collect()
    english, french = (next(r.text for r in docs if r.lang == k)[:800] for k in ("en", "fr"))
    for text in (english + " " + french, french + " " + english):
        name, score = lang.labelled(field, [text])[0]
        assert name in ("en", "fr") and 0.4 < score < 0.7


def test_nulls_symbols_repeats_and_unknown_columns(field, odd):
    rows = lang.identify(odd, field).collect()
    assert len(rows) == odd.count()
    verdicts = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    for doc_id in (2, 3, 6, 9):
        assert verdicts[doc_id] == ("und", 0.0)
    assert verdicts[8][0] == "es" and verdicts[None][0] == "de"
    assert [r.held_out for r in rows if r.doc_id is None] == [True]


def test_a_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(lang, "learned", lambda rows: taken.append(rows))
    rows = [(7, f"copy {k % 2}", "en") for k in range(3_000)] + [(k, "x" * 50, "en") for k in range(100, 200)]
    lang.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20, sample_chars=10)
    assert len(taken[0]) == 20 and max(len(t) for t, _ in taken[0]) <= 10
    assert sum(t.startswith("copy") for t, _ in taken[0]) in (0, 2)


def test_whole_rows_pass_if_they_have_a_letter(field, odd):
    rows = lang.worded(odd, field)
    assert rows.dtypes == odd.dtypes
    wanted = [r for r in odd.collect() if any(c.isalpha() for c in r.text or "")]
    found = {(r.doc_id, r.text): r for r in rows.collect()}
    assert rows.count() == len(wanted) and {(r.doc_id, r.text) for r in wanted} == set(found)
    assert found[None, wanted[[r.doc_id for r in wanted].index(None)].text].lang == "de"
    assert lang.worded(odd, None).count() == len(wanted)


def test_nothing_learned_and_empty_tables(odd, none):
    assert lang.learn(none) is None and lang.identify(none, None).count() == 0
    assert {r.lang_pred for r in lang.identify(odd, None).collect()} == {"und"}
    assert lang.learn(odd.where("lang = 'es'")) is None or lang.learn(odd.where("lang = 'es'")).languages == ["es"]
