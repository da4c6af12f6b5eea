from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import fill_in_middle as fim


def plainly(doc_id, text):
    """The contract in plain Python: n, form, prefix and middle lengths, output."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    if h4 % 100 < 20:
        return n, "spm", p, q - p, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", p, q - p, f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", None, "a", "é", "日本語のテキスト", "a<P>b", "<", "<<", ">P>", "<P", "S>", "<X>", "x<M>", "<S><P>", "🎉🎉", "áb", " \n\r\t", "<P" * 50]


def made(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_outputs_against_plain_python(spark, documents):
    rng = random.Random(5)
    rows = [(i, t, None) for i, t in enumerate(ODD * 12)]
    rows += [(1000 + i, "".join(rng.choices("ab<>PSMé日🎉 ", k=rng.randint(1, 40))), None) for i in range(500)]
    rows += [(None, "no id", None), (-7, "negative", None), (-7, "negative", None), (9, "long é " * 400_000, None)]
    frame = fim.fill_in_middle(documents(rows).repartition(3))
    assert frame.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made(frame) == sorted(((i, *plainly(i, t)) for i, t, _ in rows), key=repr)
    assert {"plain", "spm", "psm"} == {r.form for r in frame.select("form").distinct().collect()}
    back = fim.restored(frame, ["doc_id"])
    assert made(back) == sorted(((i, t or "") for i, t, _ in rows), key=repr)


def test_batches_split_by_bytes(spark, documents, monkeypatch):
    rows = [(i, "wörter " * (i % 40), None) for i in range(300)]
    frame = fim.fill_in_middle(documents(rows).coalesce(1))
    wanted = made(frame)
    for size in (1, 100, 1_000):
        monkeypatch.setattr(fim, "BATCH_BYTES", size)
        batch = documents(rows).coalesce(1).select("doc_id", "text").toArrow().combine_chunks().to_batches()
        parts = [r for b in fim.transformer(1, 90, 20)(iter(batch)) for r in b.to_pylist()]
        assert sorted((tuple(x.values()) for x in parts), key=repr) == wanted


def test_shares_are_parameters(documents):
    rows = [(i, "some text", None) for i in range(200)]
    assert {r.form for r in fim.fill_in_middle(documents(rows), fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(documents(rows), fim_percent=100, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(documents(rows), seed=2, fim_percent=100, spm_percent=0).collect()} == {"psm"}


def test_a_damaged_output_is_refused():
    data = np.frombuffer(b"<P>a<S>b<X>c", np.uint8)
    with pytest.raises(ValueError, match="three sentinels"):
        fim.gather(data, np.array([0, len(data)]), ["psm"])
    data = np.frombuffer(b"<S>a<P>b<M>c", np.uint8)
    with pytest.raises(ValueError, match="of its form"):
        fim.gather(data, np.array([0, len(data)]), ["psm"])


def test_a_sentinel_does_not_reach_over_two_texts():
    data = np.frombuffer(b"a<P>b", np.uint8)
    at = fim.sentinels(data)
    assert fim.inside(at, np.array([0, 2, 5])).tolist() == [False, False]
    assert fim.inside(at, np.array([0, 1, 5])).tolist() == [False, True]


def test_empty_table_and_plan(none, odd):
    assert fim.fill_in_middle(none).count() == 0
    assert fim.restored(fim.fill_in_middle(none), ["doc_id"]).count() == 0
    plan = fim.restored(fim.fill_in_middle(odd), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert fim.fill_in_middle(odd).where(F.col("output").isNull()).count() == 0
