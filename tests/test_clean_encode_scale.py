import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowsieve.operators import clean, encode, scale
from flowsieve.operators.bounds import bounded_rows
from flowsieve.operators.features import FlowFeatures, add_flow_features

NAN, INF = float("nan"), float("inf")


def values(df, column):
    return [row[column] for row in df.collect()]


def test_median_skips_missing_and_infinite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (NAN,), (None,), (INF,)], "x double")
    model = clean.FlowCleaner().fit(df)
    assert values(model.transform(df), "x") == [1.0, 3.0, 2.0, 2.0, 2.0]


def test_cleaner_fills_by_type_and_keeps_the_label(spark):
    rows = [(1, 4, None, None, None, "f1", "BENIGN"), (None, None, None, "tcp", True, "f2", None)]
    df = spark.createDataFrame(rows, "n int, m bigint, e double, s string, b boolean, flow_id string, label string")
    model = clean.FlowCleaner(keepCols=["label"]).fit(df)
    cleaned = model.transform(df)
    assert cleaned.columns == ["n", "m", "e", "s", "b", "label"]
    assert [tuple(r) for r in cleaned.collect()] == [
        (1.0, 4.0, 0.0, "Missing", False, "BENIGN"),
        (1.0, 4.0, 0.0, "tcp", True, None),
    ]
    zero = clean.FlowCleaner(keepCols=["label"], stringNull="0").fit(df).transform(df)
    assert values(zero, "s") == ["0", "tcp"]
    unseen = model.transform(df.withColumn("later", F.lit(None).cast("double")))
    assert values(unseen, "later") == [0.0, 0.0]


def test_approximate_median_is_an_element(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert clean.median_values(df, ["x"], "approx") == {"x": 1.0}
    with pytest.raises(ValueError):
        clean.median_values(df, ["x"], "guess")


def test_duplicate_policies(spark):
    rows = [(1.0, NAN, "A", 5), (1.0, None, "A", 3), (1.0, 2.0, "A", 1), (1.0, 2.0, "B", 2), (0.0, 1.0, None, 7), (-0.0, 1.0, None, 8)]
    df = spark.createDataFrame(rows, "x double, y double, label string, k int")
    by_key = lambda d: sorted(r["k"] for r in d.collect())
    assert by_key(clean.dedup_flows(df, label="label", key="k")) == [1, 2, 3, 7]
    assert by_key(clean.dedup_flows(df, "features", label="label", key="k")) == [3, 7]
    assert clean.dedup_flows(df, "none").count() == 6
    assert clean.dedup_flows(df.drop("k")).count() == 4
    assert clean.dedup_flows(df.drop("k", "label"), "features").count() == 3
    with pytest.raises(ValueError):
        clean.dedup_flows(df, "some")


def test_features_depend_on_the_columns_present(spark):
    df = spark.createDataFrame([(10, 4, 0.0)], "sbytes int, dbytes int, dur double")
    row = add_flow_features(df, "UNSW").first()
    assert row["bytes_ratio"] == 2.0 and row["total_bytes"] == 14.0
    assert row["src_bytes_per_second"] == pytest.approx(10000.0)
    assert "avg_bytes_per_packet" not in row and "packets_per_second" not in row and "ttl_difference" not in row
    assert add_flow_features(df, "other").columns == add_flow_features(df, "UNSW").columns
    ttl = spark.createDataFrame([(3, 10)], "sttl int, dttl int")
    assert add_flow_features(ttl, "unsw").first()["ttl_difference"] == 7.0
    assert add_flow_features(ttl, "CIC").columns == ["sttl", "dttl"]
    cic = spark.createDataFrame([(6, 2), (6, -1)], "`Total Fwd Packets` int, `Flow Duration` int")
    assert values(FlowFeatures(dataset="CIC").transform(cic), "fwd_packets_per_second") == [2.0, 0.0]


def test_integer_counters_do_not_overflow(spark):
    df = spark.createDataFrame([(2**31 - 1, 2**31 - 1)], "sbytes int, dbytes int")
    assert add_flow_features(df, "UNSW").first()["total_bytes"] == 2.0**32 - 2


def test_onehot_unknown_missing_and_alignment(spark):
    train = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None)], "c string, n double, d string")
    test = spark.createDataFrame([("c", "x", 9)], "c string, d string, extra int")
    model = encode.OneHot(handleUnknown="ignore").fit(train)
    assert model.transform(train).columns == ["n", "c_a", "c_b", "d_Missing", "d_x"]
    assert [tuple(r) for r in model.transform(test).collect()] == [(0.0, 0.0, 0.0, 0.0, 1.0)]
    with pytest.raises(Exception, match="unknown category in c"):
        encode.OneHot().fit(train).transform(test).collect()
    numbers = train.select("n")
    assert encode.OneHot().fit(numbers).transform(numbers).columns == ["n"]


def test_onehot_refuses_wide_columns(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"), F.lit("z").alias("d"))
    with pytest.raises(ValueError, match="categories"):
        encode.OneHot(maxCategories=20).fit(df)
    with pytest.raises(ValueError, match="more than 40 categories in c"):
        encode.OneHot(maxCategories=40).fit(df)


def test_onehot_vector_of_unknown_values_is_zero(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("c", "x")], "`c 1` string, d string")
    model = encode.fit_onehot_vector(df, ["c 1", "d"])
    assert model.transform(df).first()["onehot"].toArray().tolist() == [0, 1, 0, 0, 1]
    unknown = spark.createDataFrame([("z", "y")], "`c 1` string, d string")
    assert model.transform(unknown).first()["onehot"].toArray().tolist() == [0] * 5
    with pytest.raises(ValueError, match="categories"):
        encode.fit_onehot_vector(df, ["c 1"], max_categories=1)


def test_label_index_and_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "y string")
    model = encode.LabelIndex(labelCol="y", outputCol="i").fit(train)
    assert sorted(values(model.transform(train), "i")) == [0, 0, 1, 2]
    other = spark.createDataFrame([("a",), ("z",), ("z",)], "y string")
    assert values(model.unseen_labels(other), "class") == ["z"]
    with pytest.raises(Exception, match="unseen label: z"):
        model.transform(other).collect()
    keep = encode.LabelIndex(labelCol="y", outputCol="i", handleInvalid="keep").fit(train)
    assert values(keep.transform(other).orderBy("y"), "i") == [0, None, None]
    skip = encode.LabelIndex(labelCol="y", outputCol="i", handleInvalid="skip").fit(train)
    assert values(skip.transform(other), "i") == [0]
    numeric = spark.createDataFrame([(10,), (9,)], "y int")
    assert encode.LabelIndex(labelCol="y").fit(numeric).getOrDefault("classes") == ["10", "9"]
    with pytest.raises(ValueError, match="not found"):
        encode.LabelIndex(labelCol="none").fit(train)


def test_bounded_rows_raise_instead_of_cutting(spark):
    assert len(bounded_rows(spark.range(5), 5, "ids")) == 5
    with pytest.raises(ValueError, match="more than 4"):
        bounded_rows(spark.range(5), 4, "ids")


@pytest.mark.parametrize(
    "kind, data, expected",
    [
        ("minmax", [5, 5, 5], [0, 0, 0]),
        ("minmax", [0, 5, 10], [0, 0.5, 1]),
        ("standard", [1, 2, 3], [-1.224744871391589, 0, 1.224744871391589]),
        ("standard", [4, 4, 4], [0, 0, 0]),
        ("robust", [1, 2, 3], [-1, 0, 1]),
        ("robust", [7, 7, 7], [0, 0, 0]),
    ],
)
def test_scalers_on_literals(spark, kind, data, expected):
    df = spark.createDataFrame([(float(x), "k") for x in data], "x double, s string")
    scaled = scale.ColumnScaler(kind=kind).fit(df).transform(df)
    np.testing.assert_allclose(values(scaled, "x"), expected)


def test_scaler_is_not_clipped_and_ignores_other_types(spark):
    train = spark.createDataFrame([(0.0, True), (10.0, False)], "x double, b boolean")
    model = scale.ColumnScaler().fit(train)
    later = spark.createDataFrame([(20.0, True)], "x double, b boolean")
    assert tuple(model.transform(later).first()) == (2.0, True)
    text = spark.createDataFrame([("a",)], "s string")
    assert scale.ColumnScaler().fit(text).transform(text).first()[0] == "a"
    with pytest.raises(ValueError, match="unknown scaler"):
        scale.ColumnScaler(kind="cube").fit(train)


def test_fitted_stages_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, "u"), ("b", None, "v"), ("a", 5.0, "u")], "c string, x double, label string")
    cleaner = clean.FlowCleaner(keepCols=["label"]).fit(df)
    table = cleaner.transform(df)
    onehot = encode.OneHot(keepCols=["label"]).fit(table)
    scaler = scale.ColumnScaler(keepCols=["label"]).fit(onehot.transform(table))
    model = PipelineModel([cleaner, FlowFeatures(dataset="UNSW"), onehot, scaler])
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(df).collect() == model.transform(df).collect()
