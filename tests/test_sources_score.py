import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from flowsieve.operators import score, split
from flowsieve.operators.ranges import nested_ranges, sortable_number, with_range
from flowsieve.plans.flow_model import fit_detector, fit_flow_model, load_model, save_model
from flowsieve.plans.tables import flows
from flowsieve.sources import flows as sources
from flowsieve.sources import metadata

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, label",
    [
        ("Monday-WorkingHours-no-metadata", "BENIGN"),
        ("Bruteforce-Tuesday-no-metadata", "Bruteforce"),
        ("DoS-Wednesday", "DoS"),
        ("Infiltration-Thursday-no-metadata", "Infiltration"),
        ("WebAttacks-Thursday-no-metadata", "WebAttacks"),
        ("DDoS-Friday-no-metadata", "DDoS"),
        ("Portscan-Friday-no-metadata", "Portscan"),
        ("Botnet-Friday-no-metadata", "Botnet"),
        ("Friday-Other-no-metadata", "Other"),
        ("friday-ddos", "ddos"),
        ("plain", "plain"),
    ],
)
def test_label_by_file_name(spark, name, label):
    df = spark.createDataFrame([(name,)], "name string")
    row = sources.with_capture_labels(df, F.col("name")).first()
    assert (row["attack_type"], row["attack_label"], row["source_file"]) == (label, int(label != "BENIGN"), name)


def test_assemble_by_name_with_missing_columns_and_odd_names(spark, tmp_path):
    pd.DataFrame({"a": [1, 2], "b": [1.0, 2.0]}).to_parquet(tmp_path / "Benign-Monday-no-metadata.parquet")
    pd.DataFrame({"a": [3], "Total Fwd Packets": [5]}).to_parquet(tmp_path / "Scan + 100% -Sunday.parquet")
    pd.DataFrame({"a": [9]}).to_csv(tmp_path / "notes.csv")
    df = sources.assemble(spark, str(tmp_path))
    rows = {r["a"]: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[1]["attack_type"] == "BENIGN" and rows[3]["attack_type"] == "Sunday"
    assert rows[3]["source_file"] == "Scan + 100% -Sunday" and rows[3]["b"] is None and rows[1]["Total Fwd Packets"] is None
    record = metadata.dataset_metadata(df).first()
    assert record["total_samples"] == 3 and record["class_distribution"] == {"BENIGN": 2, "Sunday": 1}
    assert record["attack_types"] == ["BENIGN", "Sunday"] and len(record["source_files"]) == 2
    assert record["total_features"] == 6


def test_files_by_schema_with_odd_names(spark, tmp_path):
    for i in range(4):
        pd.DataFrame({"a": [i]}).to_parquet(tmp_path / f"Monday {i} [x] + 100%.parquet")
    pd.DataFrame({"a": [2.5], "b": ["x"]}).to_parquet(tmp_path / "Tuesday.parquet")
    groups = sources.files_by_schema(spark, f"{tmp_path}/*.parquet")
    assert sorted(map(len, groups)) == [1, 4]
    rows = sources.assemble(spark, str(tmp_path)).collect()
    assert sorted((r["a"], r["b"], r["attack_type"]) for r in rows if r["b"] is None) == [(float(i), None, "BENIGN") for i in range(4)]
    assert [(r["a"], r["attack_type"], r["source_file"]) for r in rows if r["b"]] == [(2.5, "Bruteforce", "Tuesday")]
    assert {r["source_file"] for r in rows if not r["b"]} == {f"Monday {i} [x] + 100%" for i in range(4)}


def test_assemble_widens_conflicting_types(spark, tmp_path):
    pd.DataFrame({"a": [1], "s": ["x"]}).to_parquet(tmp_path / "Monday.parquet")
    pd.DataFrame({"a": [2.5], "s": [7]}).to_parquet(tmp_path / "Tuesday.parquet")
    df = sources.assemble(spark, str(tmp_path))
    rows = sorted((r["a"], r["s"], r["attack_type"]) for r in df.collect())
    assert rows == [(1.0, "x", "BENIGN"), (2.5, "7", "Bruteforce")]


def test_split_folders_and_metadata(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("string").alias("label"))
    parts = split.three_way_split(df, "label", "id")
    sources.write_splits(parts, str(tmp_path / "csv"), "csv")
    tables = sources.read_splits(spark, {s: str(tmp_path / "csv" / f"split={s}") for s in ("train", "test", "val")}, "UNSW")
    assert {s: t.count() for s, t in tables.items()} == {"train": 70, "test": 20, "val": 10}
    record = metadata.split_metadata(parts, "label", {"test_size": 0.2, "val_size": 0.1, "random_state": 42})
    metadata.write_metadata(record, str(tmp_path / "metadata"))
    row = spark.read.json(str(tmp_path / "metadata")).where("split = 'val'").first()
    assert row["num_samples"] == 10 and row["class_distribution"]["0"] == 0.5 and row["split_parameters"]["test_size"] == 0.2
    with pytest.raises(ValueError, match="unknown corpus"):
        sources.read_splits(spark, {}, "OTHER")
    with pytest.raises(ValueError, match="unknown format"):
        sources.read_flows(spark, "x", "xml")


@pytest.mark.parametrize("pad", [False, True])
def test_sequences_of_a_hot_entity_equal_the_plain_window(spark, pad):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("e"), (F.col("id") % 50).cast("string"))).alias("e"),
        F.timestamp_seconds(F.floor(F.col("id") / 7)).alias("t"), (F.col("id") * 1.5).alias("x"), F.lit(1).alias("n"),
    )
    plain = score.sequence_windows(df, ["x", "n"], "e", "t", "id", 5, pad)
    cut = score.sequence_windows(df, ["x", "n"], "e", "t", "id", 5, pad, rows_per_range=40)
    key = lambda r: r["id"]
    assert sorted(plain.collect(), key=key) == sorted(cut.collect(), key=key)
    assert plain.count() == (2000 if pad else 2000 - 4 * df.select("e").distinct().count())


@pytest.mark.parametrize("key", ["id", "name"])
def test_sequences_at_one_crowded_moment(spark, key):
    df = spark.range(1500).select(
        "id", F.lit("hot").alias("e"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(700).alias("t"),
        F.format_string("flow-%06d", F.col("id") * 7).alias("name"),
    )
    plain = score.sequence_windows(df, ["id"], "e", "t", key, 4)
    cut = score.sequence_windows(df, ["id"], "e", "t", key, 4, rows_per_range=60)
    assert sorted(plain.collect()) == sorted(cut.select(plain.columns).collect())
    ranges = nested_ranges(df, F.col("t").cast("double"), sortable_number(df, key, df), 60, 1500)
    assert ranges.heavy == [700.0] and len(ranges.tie_cuts) > 5
    parts = with_range(df, F.col("t").cast("double"), ranges, "part", sortable_number(df, key, df))
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] < 200


def test_foreign_model_scores_in_batches(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 3.0, 1.0)], "id int, a double, `b c` double")
    load = lambda: lambda x: x / x.sum(axis=1, keepdims=True)
    rows = score.predict_batches(df, ["a", "b c"], load).orderBy("id").collect()
    assert [r["probs"] for r in rows] == [[0.0, 1.0], [0.75, 0.25]]


def test_sequence_of_one_is_the_row(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "e string, t int, x double")
    assert score.sequence_windows(df, ["x"], "e", "t", "t", 1).first()["sequence"] == [[2.0]]
    with pytest.raises(ValueError):
        score.sequence_windows(df, ["x"], "e", "t", "t", 0)


def test_vector_rejects_missing_values(spark):
    df = spark.createDataFrame([(1.0, None)], "`a.b` double, `c d` double")
    with pytest.raises(Exception, match="(?i)null"):
        score.assemble_vector(df, ["a.b", "c d"]).collect()
    assert score.assemble_vector(df, ["a.b"]).first()["features"] == Vectors.dense([1.0])


def test_reconstruction_error_equals_the_rebuilt_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 5
    df = spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(x)], ["id", "features"])
    scored = score.reconstruction_score(df, score.fit_reconstruction(df, components=2)).orderBy("id").collect()
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred)
    rebuilt = centred @ v[:2].T @ v[:2]
    np.testing.assert_allclose([r["reconstruction_error"] for r in scored], ((centred - rebuilt) ** 2).mean(1), atol=1e-9)


def test_classifiers_beat_the_majority(spark):
    rng = np.random.default_rng(9)
    y = rng.choice(2, 300, p=[0.7, 0.3])
    df = spark.createDataFrame([(float(c), Vectors.dense([float(c) + rng.normal(0, 0.3), rng.normal()]), 1.0) for c in y], ["label", "features", "w"])
    for kind, params in {"forest": {"numTrees": 10}, "logistic": {}, "perceptron": {"layers": [2, 4, 2], "seed": 1}}.items():
        weight = None if kind == "perceptron" else "w"
        model = score.train_classifier(df, "label", kind, weight=weight, **params)
        rows = score.predict(df, model).collect()
        assert np.mean([r["predicted"] == r["label"] for r in rows]) > 0.85
    with pytest.raises(ValueError, match="row weights"):
        score.train_classifier(df, "label", "perceptron", weight="w")
    with pytest.raises(ValueError, match="unknown classifier"):
        score.train_classifier(df, "label", "svm")
    best, table = score.choose_model({"good": ("logistic", {}), "none": ("logistic", {"maxIter": 0})}, df, df, "label")
    assert table.where("chosen").first()["candidate"] == "good"


def test_alerts_are_strictly_above_the_threshold(spark):
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 0.9), ("1.1.1.1", "2.2.2.2", 0.957)], "src_ip string, dst_ip string, score double")
    rows = score.alerts(df.withColumn("timestamp", F.current_timestamp())).collect()
    assert [(r["level"], r["message"]) for r in rows] == [
        ("WARNING", "ALERT: Malicious traffic detected from 1.1.1.1 to 2.2.2.2 (score: 0.96)")
    ]
    assert '"score":0.957' in rows[0]["context"]


def test_flow_model_does_not_leak_or_drop_rows(spark, tmp_path):
    raw = flows(spark, SF).withColumns({"attack_label": F.lit(1), "source_file": F.lit("x")})
    train = raw.unionByName(raw.limit(500))
    model = fit_flow_model(train, "attack_type", "UNSW", k=5, selector={"useAnova": True, "useMi": False})
    scored = model.transform(train)
    assert scored.count() == train.count()
    assert len(scored.columns) == 6 and not {"attack_label", "source_file", "flow_id"} & set(scored.columns)
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m")).transform(raw)
    assert again.exceptAll(model.transform(raw)).count() == 0


def test_detector_scores_raw_flows_and_survives_saving(spark, tmp_path):
    raw = flows(spark, SF).withColumn("spkts", F.col("spkts") + F.when(F.col("attack_type") == "A", 100).otherwise(0))
    model = fit_detector(raw, "attack_type", benign="N", dataset="UNSW", key="flow_id", keep=["src_ip", "dst_ip", "ts"],
                         select=True, k=6, selector={"useAnova": True, "useMi": False}, balanced=True,
                         classifier={"numTrees": 10, "seed": 1})
    save_model(model, str(tmp_path / "d"))
    live = raw.drop("attack_type")
    scored = load_model(str(tmp_path / "d")).transform(live)
    assert {"flow_id", "src_ip", "dst_ip", "ts", "score", "predicted_class"} <= set(scored.columns)
    both = scored.join(raw.select("flow_id", "attack_type"), "flow_id")
    assert both.where("attack_type = 'A' and predicted_class <> 'A'").count() == 0
    # the score is the probability of not being benign, so R rows may raise alerts too; A rows must
    assert both.where("attack_type = 'A' and score <= 0.9").count() == 0
    assert score.alerts(scored, time="ts").count() == scored.where("score > 0.9").count()
