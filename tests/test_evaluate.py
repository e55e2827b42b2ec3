from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.operators import evaluate, profile


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1)], "y int, p int")


def test_confusion_demo(demo):
    rows = evaluate.confusion(demo, "y", "p").collect()
    assert {(r["true_class"], r["predicted_class"]): (r["n"], r["percent"]) for r in rows} == {
        (a, b): (1, 50.0) for a in (0, 1) for b in (0, 1)
    }
    assert evaluate.macro_f1(demo, "y", "p").first()["macro_f1"] == 0.5


def test_confusion_grid_holds_absent_classes(demo):
    rows = evaluate.confusion(demo, "y", "p", [0, 1, 2]).collect()
    assert len(rows) == 9
    assert {(r["n"], r["percent"]) for r in rows if r["true_class"] == 2} == {(0, None)}


def test_class_without_prediction_counts_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    report = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert (report["b"]["precision"], report["b"]["recall"], report["b"]["f1"]) == (0.0, 0.0, 0.0)
    assert report["a"]["f1"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("rows_per_range", [2_000_000, 2])
def test_auc_of_four_scores(spark, rows_per_range):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.65, 0.35]), (1, [0.2, 0.8])], "y int, p array<double>")
    got = {r["class"]: r["auc"] for r in evaluate.auc_ovr(df, "y", "p", rows_per_range).collect()}
    assert got == {0: 0.75, 1: 0.75}
    points = evaluate.roc_points(df, "y", "p", rows_per_range).where("class = 1").orderBy("fpr", "tpr").collect()
    assert [(r["fpr"], r["tpr"]) for r in points] == [(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)]


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    y = rng.choice(3, 600, p=[0.7, 0.2, 0.1])
    p = np.round(rng.dirichlet([1, 1, 1], 600) + np.eye(3)[y] * 0.4, 2)
    p = p / p.sum(axis=1, keepdims=True)
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, p)], "y int, p array<double>").cache(), y, p


def rank_auc(y, s):
    pos, neg = s[y], s[~y]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("rows_per_range", [2_000_000, 100])
def test_auc_equals_the_pair_count(scored, rows_per_range):
    df, y, p = scored
    got = {r["class"]: r["auc"] for r in evaluate.auc_ovr(df, "y", "p", rows_per_range).collect()}
    want = {c: rank_auc(y == c, p[:, c]) for c in range(3)}
    assert got == pytest.approx(want)
    whole = evaluate.auc_summary(df, "y", "p", rows_per_range).first()
    assert whole["auc_macro"] == pytest.approx(np.mean(list(want.values())))
    assert whole["auc_weighted"] == pytest.approx(sum(want[c] * (y == c).mean() for c in range(3)))


def test_roc_points_in_ranges_equal_the_plain_ones(scored):
    df, _, _ = scored
    plain, ranged = (evaluate.roc_points(df, "y", "p", n).orderBy("class", F.desc("threshold")).collect() for n in (2_000_000, 50))
    assert plain == ranged


@pytest.mark.parametrize("rows_per_range", [2_000_000, 2])
def test_pruned_points_are_the_turns(spark, rows_per_range):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4), (0, 0.3), (0, 0.2), (0, 0.1)]
    df = spark.createDataFrame([(y, [1 - s, s]) for y, s in rows], "y int, p array<double>")
    kept = evaluate.roc_points(df, "y", "p", rows_per_range, prune=True).where("class = 1 and threshold is not null")
    assert sorted((r["threshold"] for r in kept.collect()), reverse=True) == [0.9, 0.7, 0.5, 0.4, 0.1]


def test_binned_auc_is_close_to_the_exact_one(scored):
    df, y, p = scored
    for r in evaluate.binned_auc(df, "y", "p").collect():
        assert r["binned_auc"] == pytest.approx(rank_auc(y == r["class"], p[:, r["class"]]), abs=0.01)


def test_class_without_rows_has_no_auc(spark):
    df = spark.createDataFrame([(0, [0.5, 0.3, 0.2]), (1, [0.2, 0.5, 0.3])], "y int, p array<double>")
    assert {r["class"]: r["auc"] for r in evaluate.auc_ovr(df, "y", "p").collect()} == {0: 1.0, 1: 1.0, 2: None}
    assert evaluate.auc_summary(df, "y", "p").first()["auc_macro"] == 1.0
    assert {r["tpr"] for r in evaluate.roc_points(df, "y", "p").where("class = 2").collect()} == {None}


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=30).filter(lambda rows: 0 < sum(y for y, _ in rows) < len(rows)))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_auc_does_not_change_under_monotone_maps(spark, rows):
    make = lambda f: spark.createDataFrame([(y, [1 - f(s), f(s)]) for y, s in rows], "y int, p array<double>")
    a, b = (evaluate.auc_ovr(make(f), "y", "p").where("class = 1").first()["auc"] for f in (lambda s: s / 32, lambda s: (s / 32) ** 2))
    assert a == pytest.approx(b)


def test_summary_agrees_with_the_single_metrics(scored):
    df, y, p = scored
    df = df.withColumn("back", F.transform("p", lambda x: x * 0.5)).withColumn("pred", F.array_position("p", F.array_max("p")).cast("int") - 1)
    row = evaluate.evaluation_summary(df, "y", "p", "p", "back").first()
    assert row["n_rows"] == 600
    assert row["accuracy"] == pytest.approx((p.argmax(1) == y).mean())
    assert row["macro_f1"] == pytest.approx(evaluate.macro_f1(df, "y", "pred").first()["macro_f1"])
    micro = evaluate.threshold_metrics(df, "y", "p").first()
    assert (row["false_positives"], row["false_negatives"]) == (micro["fp"], micro["fn"])
    assert row["precision"] == pytest.approx(micro["precision"])
    assert row["top3_accuracy"] == 1.0
    ce = -np.log(np.clip(p[np.arange(600), y], 1e-7, 1 - 1e-7)).mean()
    mse = ((p * 0.5) ** 2).mean()
    assert row["cross_entropy"] == pytest.approx(ce)
    assert row["loss"] == pytest.approx(ce + 0.3 * mse)
    assert evaluate.joint_loss(df, "y", "p", "p", "back").first()["joint_loss"] == pytest.approx(ce + 0.3 * mse)
    assert evaluate.evaluation_summary(df, "y", "p").first()["mse"] is None


def test_histogram_holds_every_row(spark):
    df = spark.createDataFrame([(float(i % 10), i % 3 == 0) for i in range(90)] + [(None, True)], "x double, label boolean")
    rows = evaluate.feature_histogram(df, "x", "label", 5).collect()
    assert sum(r["n"] for r in rows) == 90
    assert sum(r["density"] * 1.8 for r in rows if r["label"]) == pytest.approx(1.0)


def test_density_equals_the_kernel_sum(spark):
    rng = np.random.default_rng(4)
    normal, attack = rng.normal(100, 10, 1000).round(1), rng.normal(200, 50, 200).round(1)
    rows = [(float(x), 0) for x in normal] + [(float(x), 1) for x in attack]
    df = spark.createDataFrame(rows, "packet_size double, label int")
    got = evaluate.feature_density(df, "packet_size", "label", bins=20000)
    for label, x in ((0, normal), (1, attack)):
        part = got.where(F.col("label") == label).orderBy("point").collect()
        at = np.array([r["position"] for r in part])
        h = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose([r["density"] for r in part], want, atol=1e-9)
        assert at[0] == pytest.approx(x.min() - 3 * h) and at[-1] == pytest.approx(x.max() + 3 * h)


def test_density_with_a_far_outlier(spark):
    rng = np.random.default_rng(8)
    plain, far = rng.gamma(2, 1000, 1000), np.append(rng.gamma(2, 1000, 1000), 1e9)
    df = spark.createDataFrame([(float(x), 0) for x in plain] + [(float(x), 1) for x in far], "bytes double, label int")
    got = evaluate.feature_density(df, "bytes", "label")
    for label, x in ((0, plain), (1, far)):
        part = got.where(F.col("label") == label).orderBy("point").collect()
        at = np.array([r["position"] for r in part])
        h = x.std(ddof=1) * len(x) ** -0.2
        want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose([r["density"] * h for r in part], want * h, atol=1e-8)


def test_timeline_has_the_empty_hour(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), 1), (datetime(2024, 1, 1, 0, 50), 0), (datetime(2024, 1, 1, 2, 0), 1)], "t timestamp_ntz, label int")
    rows = evaluate.attack_timeline(df, "t", "label").orderBy("hour").collect()
    assert [(r["attack_ratio"], r["n"]) for r in rows] == [(0.5, 2), (None, 0), (1.0, 1)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, 3.0), (2, float("nan"))], "col1 int, col2 double")
    assert tuple(profile.shape(df).first()) == (2, 2)
    assert {r["column"]: r["n_missing"] for r in profile.null_profile(df).collect()} == {"col1": 0, "col2": 1}
    assert profile.column_types(df) == ["double", "int"]
    row = profile.step_profile(df, df.drop("col2"), "drop_columns").first()
    assert row["removed_columns"] == ["col2"] and row["rows_before"] == row["rows_after"] == 2
    by = profile.class_distribution(df.withColumn("s", F.lit("x")), "col1", ["s"]).collect()
    assert [r["share"] for r in by] == [0.5, 0.5]
