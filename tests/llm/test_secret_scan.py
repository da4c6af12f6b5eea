from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paceline.llm import secret_scan as scan
from paceline.llm.common import table

MIDDLE = "/root/testdata/sf0.01"
PLANTED = re.compile(r'(AKIA[A-Z0-9]{16})|(?i:password)=([0-9a-fA-F]{18})|\b([0-9a-fA-F]{40})\b')


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, MIDDLE, "documents")


def test_planted_secrets_are_found_and_numbers_are_not(docs):
    wanted = {(r.doc_id, next(filter(None, m.groups()))) for r in docs.collect() for m in PLANTED.finditer(r.text)}
    found = {(r.doc_id, r.value) for r in scan.secrets(docs).collect()}
    assert len(wanted) > 5 and found == wanted


def test_held_out_findings_are_told(spark, docs):
    """The forest learns from the candidates of half the documents and judges the others'."""
    found = scan.candidates(docs)
    known = scan.labelled(found)
    score = scan.scored(known.drop("label").where("doc_id % 2 = 1"), known.where("doc_id % 2 = 0"))
    judged = score.join(known.select("doc_id", "place", "label"), ["doc_id", "place"]).collect()
    right = [(r.score >= 0.5) == (r.label == 1) for r in judged]
    assert len(right) > 20 and sum(right) / len(right) > 0.95


def test_query_reports_digests(spark):
    rows = scan.op7_secret_scan(spark, MIDDLE).collect()
    assert rows and all(len(r.value_sha256) == 64 and r.score >= 0.5 for r in rows)


def test_main_path_runs_no_python(docs):
    plan = scan.secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction_leaves_the_rest(docs):
    clean = scan.redacted(docs)
    assert clean.columns == docs.columns
    pairs = docs.select("doc_id", F.col("text").alias("before")).join(clean, "doc_id").collect()
    assert len(pairs) == docs.count()
    for r in pairs:
        values = sorted({next(filter(None, m.groups())) for m in PLANTED.finditer(r.before)}, key=len, reverse=True)
        wanted = r.before
        for value in values:
            wanted = wanted.replace(value, scan.REDACTED)
        assert r.text == wanted and r.n_chars == len(wanted)


def test_assigned_values_of_every_kind_are_candidates(spark):
    key = "ghp_" + "aB3dE6gH9j" * 4
    texts = {
        "password: Tr0ub4dr9": ("Tr0ub4dr9", 1.0),
        "password: Tr0ub4dr&3x,": ("Tr0ub4dr&3x", 1.0),
        'with "api_key": "q7w8e9r0" in': ("q7w8e9r0", 1.0),
        '{"password":"hun;ter22","user":"bob"}': ("hun;ter22", 1.0),
        "secret: correcthorsebattery": ("correcthorsebattery", None),
        "Authorization: Bearer abcdefghijklmnop": ("abcdefghijklmnop", None),
        f"https://user:{key}@host/x": (key, 1.0),
        "password=ab@9cdefgh": ("ab@9cdefgh", 1.0),
        "Server=x1;Password=p4ss&word9;User=bob": ("p4ss&word9", 1.0),
        "mail to someone12345@host.org now": ("someone12345@host.org", 0.0),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = scan.candidates(docs)
    values = {r.doc_id: r.value for r in found.collect()}
    labels = {r.doc_id: r.label for r in scan.labelled(found).collect()}
    assert {t: (values.get(k), labels.get(k)) for k, t in enumerate(texts)} == texts


def test_rare_secrets_are_learned_among_many_other_findings(spark):
    """Of all labelled findings fewer than one in the sample is a secret; the undecided ones must be judged all the same."""
    rng = random.Random(5)
    number = lambda: str(rng.randrange(10**13, 10**14))
    token = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24)) + "7"
    sure, undecided = [token() for _ in range(4)], [token() for _ in range(4)]
    rows = [f"order {number()} was sent" for _ in range(4000)]
    rows += [f"password={v}" for v in sure] + [f"Here comes {v} alone" for v in undecided]
    found = scan.candidates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    judged = {r.value: r.score for r in scan.scored(found, sample=50).collect()}
    assert set(undecided) <= set(judged) and len(judged) > 4000 - 5
    assert all(judged[v] >= 0.5 for v in sure) and sum(s >= 0.5 for s in judged.values()) <= 8


def test_nulls_repeats_and_foreign_columns(odd, none):
    found = scan.secrets(odd).collect()
    assert {r.value for r in found} == {"a8f3e1b99c0d4e21"}
    assert sorted(r.doc_id for r in found) == sorted([1, 5, 5, *range(100, 130)])
    clean = scan.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.where("text like '%a8f3e1b99c0d4e21%'").count() == 0
    assert scan.secrets(none).count() == 0 and scan.redacted(none).count() == 0
