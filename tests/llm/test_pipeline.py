from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from paceline.llm import queries
from paceline.llm.common import shared_folder, stored, table
from tests.llm.test_packing import check
from tests.llm.test_simhash import fingerprint, groups

MIDDLE = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
HELD = [k for k in range(-40, 0) if zlib.crc32(str(k).encode()) % 5 == 0]


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(queries.CHECKS) <= set(entry.oracle_sql())


def test_operators_lists_their_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "packing"]


@pytest.fixture(scope="module")
def planted(spark, documents):
    """The small table with cases that each stage must act on."""
    source = table(spark, MIDDLE, "documents").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in source.where("doc_id < 60").collect()]
    item = table(spark, MIDDLE, "benchmark").first().text
    clean = rows[3][1]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 !!!", None), (1003, clean, "en"), (1003, clean, "en")]
    rows += [(1004, f"Before it. {item} After it came nothing more of it at all.", "en"), (1005, 'A key: token = "' + "0a1b2c3d4e" * 4 + '" was here.', "en")]
    rows += [(None, "A text without any number of its own stands here.", "en")]
    return documents(rows)


def test_stages_act_and_keep_clean_documents(spark, planted):
    folder, docs, seen = shared_folder(spark, "test"), planted, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = stored(stage(spark, docs, MIDDLE), f"{folder}/{name}")
        assert docs.columns == planted.columns
        seen[name] = (before, docs.select("doc_id", "text").collect())
    ids = {name: [{r.doc_id for r in rows} for rows in pair] for name, pair in seen.items()}
    before, after = ids["language_id"]
    assert before - after == {1000, 1001, 1002} | {r.doc_id for r in seen["language_id"][0] if not any(c.isalpha() for c in r.text or "")}
    before, after = seen["near_duplicates"]
    component = groups([(r.doc_id, fingerprint(r.text)) for r in before])
    wanted = {r.doc_id for r in before if r.doc_id == component[fingerprint(r.text)] or r.doc_id is None}
    assert sorted(r.doc_id or -1 for r in after) == sorted(i or -1 for i in wanted)
    items = [r.text for r in table(spark, MIDDLE, "benchmark").collect()]
    before, after = seen["decontamination"]
    leaked = {r.doc_id for r in before if any(i in r.text for i in items)}
    assert 1004 in leaked and {r.doc_id for r in before} - {r.doc_id for r in after} == leaked
    before, after = seen["secret_scan"]
    texts = {r.doc_id: r.text for r in after}
    assert {r.doc_id for r in before} == set(texts) and "[SECRET]" in texts[1005] and "0a1b2c" not in texts[1005]
    packed = corpus_pipeline.packing(spark, docs, MIDDLE).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], packed, 2048)


def test_rows_with_null_or_equal_ids_are_told_apart(spark, documents):
    source = [r.text for r in table(spark, MIDDLE, "documents").where("n_chars between 300 and 900").orderBy("doc_id").limit(40).collect()]
    unlike = list({fingerprint(t): t for t in source if sum(c.isalpha() for c in t) > 200}.values())
    x, y, p, q, clean, other = unlike[0:24:4]
    leaked = f"Before it. {table(spark, MIDDLE, 'benchmark').first().text} After it."
    docs = documents([(i, t, "en") for i, t in [(None, "12 34"), (7, "12 34"), (7, clean)]])
    assert [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, MIDDLE).collect()] == [(7, clean)]
    docs = documents([(i, t, "en") for i, t in [(None, leaked), (7, leaked), (7, "Nothing of it is here."), (None, "Nor here.")]])
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, MIDDLE).collect()}
    assert kept == {(7, "Nothing of it is here."), (None, "Nor here.")}
    rows = [(6, x), (6, y), (3, y), (None, x), (9, p), (9, q), (9, q), (None, other), (None, other)]
    kept = corpus_pipeline.near_duplicates(spark, documents([(i, t, "en") for i, t in rows]), MIDDLE).collect()
    component = groups([(k, fingerprint(t)) for k, t in enumerate([x, y, p, q, other])])
    assert len(set(component.values())) == 5
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, [(6, x), (3, y), (9, p), (9, q), (None, other)]))


def test_no_text_with_a_letter_goes_where_no_language_is_known(spark, documents):
    rows = [(k, f"Some text number {k} of this corpus.", None) for k in range(20)] + [(30, "12 34", None), (31, None, None)]
    kept = corpus_pipeline.language_id(spark, documents(rows), MIDDLE)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert {r.lang for r in kept.collect()} == {None}


def test_a_missing_language_is_named(spark, documents):
    source = table(spark, MIDDLE, "documents").where("lang in ('en', 'fr') and n_chars > 400").select("doc_id", "text", "lang").collect()
    by_lang = {k: [r for r in source if r.lang == k] for k in ("en", "fr")}
    rows = [tuple(r) for x in by_lang.values() for r in x[:30]]
    asked = {-k: x for k, x in ((1, by_lang["en"][-1]), (2, by_lang["fr"][-1]))}
    rows += [(k, r.text, None) for k, r in asked.items()] + [(-3, by_lang["en"][-2].text, "xx")]
    kept = corpus_pipeline.language_id(spark, documents(rows), MIDDLE).collect()
    found = {r.doc_id: r.lang for r in kept}
    assert len(kept) == len(rows) and {k: found[k] for k in asked} == {k: r.lang for k, r in asked.items()} and found[-3] == "xx"


def test_sequences_hold_the_language_that_was_found(spark, documents):
    source = table(spark, LARGER, "documents").where("lang in ('en', 'fr') and n_chars > 400").select("doc_id", "text", "lang").collect()
    english, french = ([r for r in source if r.lang == k] for k in ("en", "fr"))
    rows = [(r.doc_id, r.text, r.lang) for x in (english[:60], french[:60]) for r in x]
    # a missing label, one that the text contradicts, one of a language hardly known, no letter; the first two are held out
    rows += [(HELD[0], english[-1].text, None), (HELD[1], french[-1].text, "en"), (-3, english[-2].text, "xx"), (-4, "12 34", "en")]
    docs = corpus_pipeline.language_id(spark, documents(rows), MIDDLE)
    packed = corpus_pipeline.packing(spark, stored(docs, f"{shared_folder(spark, 'test')}/docs"), MIDDLE).collect()
    check([(i, t) for i, t, _ in rows if i != -4], packed, 2048)
    wanted = {i: {HELD[0]: "en", HELD[1]: "fr"}.get(i, k) for i, _, k in rows if i != -4}
    assert {r.doc_id: r.lang for r in packed} == wanted
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, set()).add(wanted[r.doc_id])
    assert set(map(len, held.values())) == {1}
    for name in ("en", "fr"):  # each as tight as if it were packed alone
        alone = corpus_pipeline.packing(spark, documents([(i, t, name) for i, t, _ in rows if wanted.get(i) == name]), MIDDLE)
        assert alone.select("sequence_id").distinct().count() == sum(x == {name} for x in held.values())


def test_documents_without_a_language_are_packed(spark, documents):
    rows = [(k, f"Some text number {k} of this corpus.", None if k % 2 else "xx") for k in range(20)]
    packed = corpus_pipeline.packing(spark, documents(rows), MIDDLE).collect()
    check([(i, t) for i, t, _ in rows], packed, 2048)
    assert {(r.lang, r.sequence_id) for r in packed} == {(None, packed[[r.lang for r in packed].index(None)].sequence_id), ("xx", packed[[r.lang for r in packed].index("xx")].sequence_id)}
    assert len({r.sequence_id for r in packed}) == 2


def test_row_local_stages_shuffle_no_text(spark, documents):
    docs = documents([(1, "A text of some words.", "en"), (2, "Ein Text aus Wörtern.", "de")])
    for stage in (corpus_pipeline.language_id, corpus_pipeline.decontamination):
        plan = stage(spark, docs, MIDDLE)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_columns_named_like_the_stages_own(spark, none):
    docs = none.select("*", *(F.lit(1).alias(c) for c in ("row", "group", "place", "text_here", "lang_pred", "score", "first")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, MIDDLE)
        assert docs.count() == 0 and docs.columns[-1] == "first"
    source = table(spark, MIDDLE, "documents").where("n_chars > 300").limit(5)
    clash = source.select("*", *(F.lit(1).alias(c) for c in ("row", "key", "group", "place", "text_here")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, clash, MIDDLE)
        assert kept.columns == clash.columns and kept.dtypes == clash.dtypes and 0 < kept.count() <= 5


def test_run_over_the_whole_table(spark):
    rows = corpus_pipeline.run(spark, MIDDLE)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
    assert 0 < rows.select("doc_id").distinct().count() <= table(spark, MIDDLE, "documents").count()
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_documents(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, MIDDLE)
        assert docs.count() == 0


def test_language_id_sends_each_text_to_python_once(spark, documents):
    docs = documents([(1, "A text of some words.", "en"), (2, "Ein Text aus Wörtern.", "de")])
    plan = corpus_pipeline.language_id(spark, docs, MIDDLE)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "MapInArrow"
    assert re.findall(r"(\w+)#", plan.children().head().output().mkString(",")) == docs.columns
