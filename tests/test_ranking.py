import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import ranking


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def brute_force_mi(x, y, k=3):
    """The estimator by its definition, row by row."""
    counts = {c: int((y == c).sum()) for c in np.unique(y)}
    keep = np.array([counts[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        same = np.abs(x[(y == y[i])] - x[i])
        r = np.sort(same)[min(k, counts[y[i]] - 1)]
        if r == 0:
            a, m = (same == 0).sum(), (x == x[i]).sum()
        else:
            a, m = (same < r).sum(), (np.abs(x - x[i]) < r).sum()
        total += psi(a) - psi(counts[y[i]]) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    y = rng.choice(["a", "a", "b", "c"], 400)
    y[0] = "lone"
    y[1:3] = "pair"
    shift = np.select([y == "a", y == "b"], [0.0, 1.5], 3.0)
    data = {
        "informative": rng.normal(0, 1, 400) + shift,
        "noise": rng.normal(5, 100, 400),
        "counter": rng.integers(0, 5, 400) + (y == "c") * 2.0,
        "hot value": np.where(rng.random(400) < 0.5, 3.0, rng.random(400) * 10),
        "constant": np.full(400, 2.0),
        "flag": (y == "b") * 1.0,
    }
    rows = [(str(label), *[float(v[i]) for v in data.values()]) for i, label in enumerate(y)]
    df = spark.createDataFrame(rows, ["y", *data]).cache()
    return df, data, y


@pytest.mark.parametrize("rows_per_range", [2_000_000, 60])
def test_mutual_info_equals_brute_force(sample, rows_per_range):
    df, data, y = sample
    got = {r["feature"]: r["mi_score"] for r in ranking.mutual_info(df, list(data), "y", rows_per_range=rows_per_range).collect()}
    for name, values in data.items():
        assert got[name] == pytest.approx(brute_force_mi(values, y), abs=1e-9), name
    assert got["informative"] > got["noise"]


def test_mutual_info_needs_complete_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "y string, x double")
    with pytest.raises(ValueError, match="missing"):
        ranking.mutual_info(df, ["x"], "y")


def test_anova_equals_the_definition(sample):
    df, data, y = sample
    got = {r["feature"]: r["f_score"] for r in ranking.anova_f(df, list(data), "y").collect()}
    groups = [np.flatnonzero(y == c) for c in np.unique(y)]
    for name in ("informative", "noise", "counter"):
        x = data[name]
        between = sum(len(g) * (x[g].mean() - x.mean()) ** 2 for g in groups) / (len(groups) - 1)
        within = sum(((x[g] - x[g].mean()) ** 2).sum() for g in groups) / (len(x) - len(groups))
        assert got[name] == pytest.approx(between / within)
    assert got["constant"] is None
    assert got["flag"] == float("inf")


def test_anova_from_counted_values_equals_that_of_the_rows(spark, sample):
    df, data, _ = sample
    names = [*data, "far", "gaps", "third"]
    far = F.when(F.col("y") == "b", 1e9).otherwise(1e9 + 1) + F.col("noise") / 1e3
    df = df.withColumns({"far": far, "gaps": F.when(F.col("noise") > 0, F.col("counter")), "third": F.when(F.col("y") == "b", 0.1).otherwise(0.7)})
    rows = {r["feature"]: r["f_score"] for r in ranking.anova_f(df, names, "y").collect()}
    counted = {r["feature"]: r["f_score"] for r in ranking.anova_f(df, names, "y", ranking.value_counts(df, names, "y")).collect()}
    assert rows.keys() == counted.keys() and rows.pop("constant") is None
    assert {name: counted[name] for name in rows} == pytest.approx(rows, rel=1e-6)  # values near 1e9 have 7 digits after the point
    assert counted["third"] == float("inf") and counted["constant"] is None


def test_selector_reads_the_rows_once_for_both_scores(spark, sample, tmp_path):
    df, data, _ = sample
    path = str(tmp_path / "rows")
    df.write.parquet(path)
    rows = spark.read.parquet(path)
    scores = ranking.FeatureSelector(labelCol="y", useAnova=True, useMi=True).scores(rows)
    assert not set(scores.inputFiles()) & set(rows.inputFiles())  # all that is left to do is done on the counted values
    got = {r["feature"]: (r["f_score"], r["mi_score"]) for r in scores.collect()}
    apart = ranking.anova_f(rows, list(data), "y").join(ranking.mutual_info(rows, list(data), "y"), "feature")
    for r in apart.collect():
        assert got.pop(r["feature"]) == pytest.approx((r["f_score"], r["mi_score"]))
    assert not got


def test_consensus_of_literal_scores(spark):
    scores = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 3.0, 5.0)], "feature string, s double, t double")
    rows = ranking.consensus(scores).collect()
    assert [(r["feature"], r["consensus"]) for r in rows] == [("c", 0.5), ("b", 0.25), ("a", 0.0)]
    ranks = spark.createDataFrame([("a", 1), ("b", 3)], "feature string, rfe_rank int")
    assert [r["consensus"] for r in ranking.consensus(ranks).collect()] == [1.0, 0.0]
    assert ranking.select_top(ranking.consensus(scores), 2) == ["c", "b"]


def test_forest_and_elimination_put_the_informative_feature_first(sample):
    df, data, _ = sample
    indexed = df.withColumn("i", F.when(F.col("y") == "a", 0).when(F.col("y") == "b", 1).otherwise(2))
    names = ["informative", "noise", "hot value", "constant"]
    scores = {r["feature"]: r["rf_importance"] for r in ranking.rf_importance(indexed, names, "i", trees=20).collect()}
    assert max(scores, key=scores.get) == "informative"
    ranks = {r["feature"]: r["rfe_rank"] for r in ranking.rfe_rank(indexed, names, "i", keep=1, trees=10).collect()}
    assert ranks["informative"] == 1
    assert sorted(ranks.values()) == [1, 2, 3, 4]


def test_forest_is_as_deep_as_its_features(spark):
    rng = np.random.default_rng(6)
    bits = rng.random((4000, 10)) < 0.3
    first = np.where(bits.any(1), bits.argmax(1), 10) % 2  # the last bits count only where all before are 0
    names = [f"b{i}" for i in range(10)] + ["noise"]
    rows = [[float(y), *map(float, b), float(x)] for y, b, x in zip(first, bits, rng.random(4000) < 0.3)]
    df = spark.createDataFrame(rows, ["y", *names])
    scores = {r["feature"]: r["rf_importance"] for r in ranking.rf_importance(df, names, "y", trees=5, featureSubsetStrategy="all").collect()}
    assert scores["b8"] > 0.01 and scores["b9"] > 10 * scores["noise"]
    ranks = {r["feature"]: r["rfe_rank"] for r in ranking.rfe_rank(df, names, "y", keep=10, trees=5, featureSubsetStrategy="all").collect()}
    assert ranks["noise"] == 2


def test_selector_keeps_label_and_best(sample, spark):
    df, _, _ = sample
    model = ranking.FeatureSelector(k=2, labelCol="y", useAnova=True, useMi=True).fit(df)
    assert model.transform(df).columns == ["y", *model.getOrDefault("selected")]
    assert len(model.getOrDefault("ranking")) == 6
    with pytest.raises(ValueError, match="at least one"):
        ranking.FeatureSelector(labelCol="y", useMi=False).fit(df)
    with pytest.raises(ValueError, match="not been fitted"):
        ranking.FeatureSelectorModel().transform(df)
