"""Inputs that once gave wrong or failing results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.vectors import cross_entropy, in_top_k, mean_squared_error
from flowsieve.operators import evaluate, quantiles, score
from flowsieve.operators.ranges import sortable_number
from flowsieve.plans.flow_model import fit_detector


def test_benign_class_must_be_known(spark):
    rows = [(float(i), "Exploits" if i % 2 else "Normal") for i in range(20)]
    with pytest.raises(ValueError, match="BENIGN"):
        fit_detector(spark.createDataFrame(rows, "x double, attack_type string"), "attack_type", select=False)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 2])
def test_missing_scores_are_left_out_on_either_path(spark, rows_per_range):
    good = [(i % 2, [1 - i / 10, i / 10]) for i in range(10)]
    bad = [(0, [None, 0.4]), (1, [float("nan"), None]), (None, [0.5, 0.5]), (1, None)]
    frame = lambda rows: spark.createDataFrame(rows, "y int, p array<double>")
    want = {r["class"]: r["auc"] for r in evaluate.auc_ovr(frame(good + [(0, [0.4])]), "y", "p").collect()}
    got = {r["class"]: r["auc"] for r in evaluate.auc_ovr(frame(good + bad), "y", "p", rows_per_range).collect()}
    assert got[0] == pytest.approx({r["class"]: r["auc"] for r in evaluate.auc_ovr(frame(good), "y", "p").collect()}[0])
    assert set(got) == set(want)
    points = evaluate.roc_points(frame(good + bad), "y", "p", rows_per_range).where("class = 0").collect()
    assert max(p["tpr"] for p in points) == max(p["fpr"] for p in points) == 1.0


def test_histogram_and_density_skip_infinite_values(spark):
    df = spark.createDataFrame([(float(i % 7), "a") for i in range(70)] + [(math.inf, "a"), (math.nan, "a"), (None, "a")], "x double, y string")
    bins = evaluate.feature_histogram(df, "x", "y", 7).collect()
    assert sum(b["n"] for b in bins) == 70 and all(math.isfinite(b["density"]) for b in bins)
    assert all(math.isfinite(r["density"]) for r in evaluate.feature_density(df, "x", "y", grid=5).collect())


def test_reconstruction_of_few_columns(spark):
    rng = np.random.default_rng(1)
    df = score.array_vector(spark.createDataFrame([(rng.normal(size=3).tolist(),) for _ in range(40)], "a array<double>"), "a")
    model = score.fit_reconstruction(df)
    assert max(r["reconstruction_error"] for r in score.reconstruction_score(df, model).collect()) < 1e-12
    lossy = score.fit_reconstruction(df, components=2)
    rebuilt = score.rebuilt_rows(df, lossy).select("a", mean_squared_error(F.col("values"), F.col("rebuilt")).alias("e")).collect()
    scored = {tuple(r["a"]): r["reconstruction_error"] for r in score.reconstruction_score(df, lossy).collect()}
    assert all(r["e"] == pytest.approx(scored[tuple(r["a"])]) for r in rebuilt)


def test_class_outside_the_array_is_a_miss(spark):
    df = spark.createDataFrame([(5, [0.9, 0.1]), (0, [0.9, 0.1]), (None, [0.9, 0.1])], "y int, p array<double>")
    rows = df.select(in_top_k(F.col("p"), F.col("y"), 2).alias("k"), cross_entropy(F.col("p"), F.col("y")).alias("c")).collect()
    assert [r["k"] for r in rows] == [False, True, None]
    assert rows[0]["c"] == pytest.approx(-math.log(1e-7)) and rows[2]["c"] is None


def test_quantiles_take_the_same_passes_on_heavy_tails(spark, monkeypatch):
    passes = []
    inner = quantiles.order_statistics
    monkeypatch.setattr(quantiles, "order_statistics", lambda df, targets, **kw: passes.append(max(b.rows for b in targets.values())) or inner(df, targets, **kw))
    even = spark.range(100_000).select((F.col("id") / 100_000).alias("u"))
    heavy = even.select(F.exp(40 * F.col("u")).alias("u"))
    values = np.arange(100_000) / 100_000
    for frame, data in ((even, values), (heavy, np.exp(40 * values))):
        got = quantiles.exact_quantiles(frame, ["u"], [0.25, 0.5, 0.99])["u"]
        assert got == pytest.approx(np.quantile(data, [0.25, 0.5, 0.99]).tolist(), rel=1e-12)
    assert max(passes) < quantiles.LAST_ROWS  # sorted at once: no histogram pass


def test_timeline_refuses_wrong_times(spark):
    df = spark.sql("select timestamp'1970-01-01 00:00:00' as t, 1 as y union all select timestamp'2024-01-01 00:00:00', 0")
    with pytest.raises(ValueError, match="hours"):
        evaluate.attack_timeline(df, "t", "y", max_hours=1000)
    assert evaluate.attack_timeline(df.where("false"), "t", "y").collect() == []


def test_one_foreign_key_does_not_crowd_the_others(spark):
    keys = [f"sensor-long-prefix-{i:04d}" for i in range(999)] + ["A"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    placed = sorted((r["k"], r["x"]) for r in df.select("k", sortable_number(df, "k", df).alias("x")).collect())
    assert len({x for _, x in placed}) > 200
    assert [x for _, x in placed] == sorted(x for _, x in placed)
