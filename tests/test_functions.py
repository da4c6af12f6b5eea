from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.functions import canonical, draws, linalg, vectors
from paceline.functions.score import (
    ScoreRule,
    guarded_ratio,
    l1_distance,
    named_l1_distance,
    rule_violation,
    score_columns,
)
from paceline.sources.grid import AXES, config_grid, grid_size, total_grid_size


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit_array(values, kind="double"):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def scored(spark, rule, mean, vol, turnover=None):
    cells = score_columns(rule, F.lit(mean), F.lit(vol), F.lit(turnover).cast("double"))
    return spark.range(1).select(*cells).first()


def test_research_score_is_the_ratio(spark):
    row = scored(spark, ScoreRule(), 0.01, 0.15, 0.4)
    assert row["meta_score"] == row["forward_sharpe"] == pytest.approx(0.01 / 0.15)
    assert row["turnover_vs_prev_best"] is None and row["lambda_used"] == 0.0


def test_continuous_score_charges_turnover(spark):
    moved = one(spark, l1_distance(lit_array([0.6, 0.4]), lit_array([0.5, 0.5])))
    assert moved == pytest.approx(0.2)
    row = scored(spark, ScoreRule("continuous", 0.3), 0.01, 0.15, moved)
    assert row["meta_score"] == pytest.approx(0.01 / 0.15 - 0.3 * 0.2)


def test_cold_turnover_is_the_size_of_the_weights(spark):
    nothing = F.lit(None).cast("array<double>")
    assert one(spark, l1_distance(lit_array([0.6, 0.4]), nothing)) == pytest.approx(1.0)


def test_zero_risk_scores_zero(spark):
    assert one(spark, guarded_ratio(F.lit(0.01), F.lit(0.0))) == 0.0
    assert one(spark, guarded_ratio(F.lit(0.01), F.lit(-1e-13))) == 0.0


def test_lengths_must_agree(spark):
    assert one(spark, l1_distance(lit_array([0.6, 0.4]), lit_array([1.0]))) is None
    assert one(spark, vectors.dot(lit_array([0.6, 0.4]), lit_array([1.0]))) is None


def test_turnover_by_ticker(spark):
    found = one(
        spark,
        named_l1_distance(
            lit_array([0.6, 0.4]), lit_array(["A", "B"], "string"),
            lit_array([0.5, 0.3, 0.2]), lit_array(["B", "C", "A"], "string"),
        ),
    )
    assert found == pytest.approx(abs(0.6 - 0.2) + abs(0.4 - 0.5) + 0.3)


@pytest.mark.parametrize("mode, lam", [("continuous", 0.0), ("research", 0.1), ("other", 0.0)])
def test_bad_rules(spark, mode, lam):
    with pytest.raises(ValueError):
        ScoreRule(mode, lam)
    assert one(spark, rule_violation(F.lit(mode), F.lit(lam))) is True


def test_null_rule_is_broken(spark):
    assert one(spark, rule_violation(F.lit(None).cast("string"), F.lit(0.0))) is True
    assert one(spark, rule_violation(F.lit("research"), F.lit(0.0))) is False


def canon(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", canonical.canonical_json("t").alias("c")).select("i", "c.*").orderBy("i")
    return [(r["canonical"], r["problem"]) for r in rows.collect()]


def test_equivalent_texts_have_one_canonical_form(spark):
    forms = canon(
        spark,
        '{"a": 1, "b": {"y": 0.1, "x": null}}',
        '{ "b": {"y": 0.10000000000001}, "a": 1, "z": null}',
    )
    assert forms[0] == forms[1] == ('{"_v":1,"config":{"a":1,"b":{"y":0.1}}}', None)


def test_differing_texts_stay_apart(spark):
    texts = ['{"a":1}', '{"a":true}', '{"a":1.0}', '{"a":"1"}', '{"a":[1,2]}', '{"a":[2,1]}', '{"a":[1,null,2]}']
    assert len({c for c, _ in canon(spark, *texts)}) == len(texts)


def test_bad_texts_are_reported(spark):
    found = canon(spark, '{"a": NaN}', '{"a": [-Infinity]}', "[1]", "{", None)
    assert [c for c, _ in found] == [None] * 5
    assert [p for _, p in found] == [
        "number is not finite", "number is not finite", "not an object", "invalid JSON", "no text",
    ]


def test_unsupported_value_types():
    with pytest.raises(TypeError):
        canonical.canonical_text({"a": b"x"})
    with pytest.raises(ValueError):
        canonical.canonical_text({"a": math.inf})


def test_grid(spark):
    rows = config_grid(spark).collect()
    sizes = {f: sum(r["family"] == f for r in rows) for f in AXES}
    assert sizes == {f: grid_size(f) for f in AXES}
    assert sizes == {
        "composite": 27, "max_mean": 12, "max_min": 12, "max_sharpe": 36, "min_drawdown": 12,
    }
    assert len(rows) == total_grid_size() == 99
    assert len({r["config_hash"] for r in rows}) == 99
    for r in rows:
        payload = json.loads(r["config_json"])
        config = payload["config"]
        assert config["objective"] == r["family"]
        # The struct's text equals the free-form canonical text, so keys agree.
        assert canonical.canonical_text(config) == r["config_json"]
        assert hashlib.sha256(r["config_json"].encode()).hexdigest()[:16] == r["config_hash"]
        assert config["cardinality"]["min_names"] < config["cardinality"]["max_names"]
        assert ("target_std" in config) == (r["family"] == "max_sharpe")
        assert ("components" in config) == (r["family"] == "composite")
    for f in AXES:
        assert sorted(r["idx"] for r in rows if r["family"] == f) == list(range(sizes[f]))


def test_draws_follow_their_distribution_and_key(spark):
    keys = spark.range(20000, numPartitions=7).select(F.col("id").cast("string").alias("k"))
    cells = [draws.keyed_uniform(F.col("k")).alias("u"), draws.keyed_normal(F.col("k")).alias("z")]
    first = keys.select("k", *cells).orderBy("k").toPandas()
    second = keys.repartition(3).select("k", *cells).orderBy("k").toPandas()
    assert first.equals(second)
    assert 0 <= first.u.min() and first.u.max() < 1 and abs(first.u.mean() - 0.5) < 0.01
    assert abs(first.z.mean()) < 0.03 and abs(first.z.std() - 1) < 0.03


def test_systems_against_numpy(spark):
    rng = np.random.default_rng(3)
    dim, cases = 8, 20
    rows, wanted = [], []
    for _ in range(cases):
        half = rng.normal(size=(dim, dim))
        a = half @ half.T + np.eye(dim)
        b, x = rng.normal(size=dim), rng.normal(size=dim)
        rows.append(([float(a[i, j]) for i, j in linalg.upper(dim)], b.tolist(), x.tolist()))
        inverse = np.linalg.inv(a)
        wanted.append((inverse @ b, np.trace(inverse), x @ inverse @ b, x @ inverse @ x))
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, x array<double>").coalesce(1)
    full = linalg.system(dim, "a", ["b", "x", linalg.IDENTITY])
    solved = df.selectExpr("*", f"{linalg.solve(dim, full)} AS s").selectExpr(
        "x",
        f"{linalg.side(dim, 's', 0)} AS mu",
        f"{linalg.side(dim, 's', 1)} AS v",
        f"{linalg.trace(dim, 's', 2)} AS t",
    )
    forms = solved.selectExpr("*", f"{linalg.dot(dim, 'x', 'mu')} AS xb", f"{linalg.dot(dim, 'x', 'v')} AS xx")
    for got, (mu, t, xb, xx) in zip(forms.collect(), wanted):
        np.testing.assert_allclose(got["mu"], mu, rtol=1e-9)
        np.testing.assert_allclose([got["t"], got["xb"], got["xx"]], [t, xb, xx], rtol=1e-9)


def test_labels_and_simplex(spark):
    assert one(spark, vectors.ticker_labels(F.lit(3))) == ["S00", "S01", "S02"]
    assert one(spark, vectors.ticker_labels(F.lit(0))) == []
    assert one(spark, vectors.to_simplex(lit_array([1.0, 3.0]))) == [0.25, 0.75]
