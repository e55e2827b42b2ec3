from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowsieve.operators import score
from flowsieve.operators.encode import OneHot
from flowsieve.plans.flow_model import fit_detector, load_model, save_model
from flowsieve.sources import metadata
from flowsieve.streaming import detect


def test_divide_takes_bad_rows_out_before_the_vector(spark):
    train = spark.createDataFrame([("tcp", 1.0), ("udp", 2.0), ("tcp", 4.0)], "proto string, x double")
    encoder = OneHot(handleUnknown="error").fit(train)
    pack = score.PackFeatures(inputCols=["x", "proto_tcp", "proto_udp"])
    live = spark.createDataFrame([("tcp", 5.0), ("icmp", 1.0), ("udp", None), (None, None), ("udp", float("nan"))], "proto string, x double")
    scored, dead = detect.divide(live, PipelineModel([encoder, pack]))
    assert [r["features"].toArray().tolist() for r in scored.collect()] == [[5.0, 1.0, 0.0]]
    assert "error" not in scored.columns and "record" not in scored.columns
    found = sorted((r["error"], json.loads(r["record"]).get("proto")) for r in dead.collect())
    assert found == [("missing value in x", "udp"), ("missing value in x", "udp"), ("unknown category in proto: Missing", None), ("unknown category in proto: icmp", "icmp")]
    messages = {r["message"] for r in detect.scoring_letters(dead).collect()}
    assert "Packet processing failed: unknown category in proto: icmp" in messages


def test_divide_keeps_earlier_errors_and_equals_the_model(spark):
    rows = [("a" if i % 3 else "b", float(i % 7), "BENIGN" if i % 2 else "DoS") for i in range(60)]
    train = spark.createDataFrame(rows, "proto string, x double, attack_type string")
    model = fit_detector(train, "attack_type", kind="bayes", select=False, unknown="error")
    live = train.withColumn("error", F.when(F.col("x") == 6, F.lit("malformed record")))
    scored, dead = detect.divide(live, model)
    expected = model.transform(train.where("x <> 6")).select("score").collect()
    assert sorted(r["score"] for r in scored.collect()) == pytest.approx(sorted(r["score"] for r in expected))
    assert {r["error"] for r in dead.collect()} == {"malformed record"} and dead.count() == train.where("x = 6").count()


def test_pack_sequence_names_bad_windows(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[1.0, 2.0]]), (3, [[1.0, None], [3.0, 4.0]]), (4, None)]
    df = spark.createDataFrame(rows, "k int, sequence array<array<double>>")
    stage = score.PackSequence(windowSize=2, width=2)
    scored, dead = detect.divide(df, PipelineModel([stage]))
    assert [r["features"].toArray().tolist() for r in scored.collect()] == [[1.0, 2.0, 3.0, 4.0]]
    assert sorted(r["error"] for r in dead.collect()) == ["missing value in a window", "window of another shape", "window of another shape"]
    with pytest.raises(Exception, match="another shape"):
        stage.transform(df).collect()


def test_sequence_stage_is_persistable(spark, tmp_path):
    df = spark.createDataFrame([([[1.0], [2.0]],)], "sequence array<array<double>>")
    PipelineModel([score.PackSequence(windowSize=2)]).write().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(df).first()["features"].toArray().tolist() == [1.0, 2.0]


def test_folds_choose_the_better_candidate(spark):
    rows = [(i, float(i % 4), float(i % 3), float(i % 4 > 1)) for i in range(200)]
    df = score.assemble_vector(spark.createDataFrame(rows, "k long, a double, b double, y double"), ["a", "b"])
    one = {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}
    model, table = score.choose_over_folds({"bayes": ("bayes", {}), "stump": ("forest", one)}, df, "y", "k")
    found = {r["candidate"]: (r["macro_f1"], r["chosen"]) for r in table.collect()}
    assert found["stump"] == (1.0, True) and found["bayes"][0] < 1 and not found["bayes"][1]
    assert model.transform(df).where("prediction <> y").count() == 0
    with pytest.raises(ValueError, match="two folds"):
        score.choose_over_folds({}, df, "y", "k")


def _hosts(spark, n):
    rows = [(str(i), "N" if i % 3 else "A", float(i % 5), f"h{i % n}", "tcp" if i % 2 else "udp") for i in range(120)]
    return spark.createDataFrame(rows, "flow_id string, attack_type string, spkts double, host string, proto string")


def test_wide_categories_agree_with_columns_and_survive_saving(spark, tmp_path):
    """One sparse vector or a column for each category: the classifier's probabilities are equal."""
    raw = _hosts(spark, 30)
    common = {"benign": "N", "kind": "bayes", "dataset": "UNSW", "key": "flow_id", "select": False}
    wide = fit_detector(raw, "attack_type", max_categories=20, **common)
    assert any(type(s).__name__ == "PackCategories" for s in wide.stages)
    narrow = fit_detector(raw, "attack_type", max_categories=200, **common)
    save_model(wide, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    new = raw.limit(1).withColumn("host", F.lit("never seen")).unionByName(raw.limit(1).withColumn("host", F.lit(None).cast("string")))
    rows = raw.unionByName(new)
    got = [sorted((r["flow_id"], round(r["score"], 9)) for r in m.transform(rows).collect()) for m in (wide, narrow, again)]
    assert got[0] == got[1] == got[2]
    assert len(wide.transform(raw.drop("host")).collect()) == 120


def test_unknown_wide_category_is_a_dead_letter(spark):
    raw = _hosts(spark, 30)
    model = fit_detector(raw, "attack_type", benign="N", kind="bayes", dataset="UNSW", key="flow_id", select=False, max_categories=20, unknown="error")
    rows = raw.unionByName(raw.limit(2).withColumn("host", F.lit("odd")))
    scored, dead = detect.divide(rows, model)
    assert scored.count() == 120
    assert [r["error"] for r in dead.collect()] == ["unknown category in host: odd"] * 2
    with pytest.raises(Exception, match="unknown category in host: odd"):
        model.transform(rows).select("score").collect()


def test_more_wide_categories_than_allowed(spark):
    raw = _hosts(spark, 30)
    with pytest.raises(ValueError, match="more than 25 categories in host"):
        fit_detector(raw, "attack_type", benign="N", kind="bayes", dataset="UNSW", key="flow_id", select=False, max_categories=20, max_wide=25)


def test_joint_detector_equals_its_parts(spark, tmp_path):
    """The reconstruction head of a reloaded detector against NumPy's components of the scaled columns."""
    raw = _hosts(spark, 4).withColumn("dur", (F.col("flow_id").cast("int") % 11).cast("double") * F.col("spkts"))
    model = fit_detector(raw, "attack_type", benign="N", kind="bayes", components=2, dataset="UNSW", key="flow_id", select=False, dedup="none")
    save_model(model, str(tmp_path / "m"))
    rows = load_model(str(tmp_path / "m")).transform(raw).select("flow_id", "features", "reconstruction_error", "score").collect()
    x = np.array([r["features"].toArray() for r in rows])
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    lost = ((centred - centred @ axes[:2].T @ axes[:2]) ** 2).mean(1)
    assert [r["reconstruction_error"] for r in rows] == pytest.approx(lost.tolist(), abs=1e-9)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_linked_record_counts_files_and_missing_names(spark, tmp_path):
    df = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f1"), (None, "f1"), ("b", None)], "attack_type string, source_file string")
    record = metadata.linked_metadata(df, str(tmp_path / "files")).first()
    assert (record["total_samples"], record["n_source_files"], record["class_distribution"]) == (5, 2, {"a": 2, "b": 2})
    assert "source_files" not in record.asDict() and spark.read.parquet(record["source_table"]).count() == 5
    empty = metadata.linked_metadata(df.limit(0), str(tmp_path / "none")).first()
    assert empty["n_source_files"] == 0 and empty["class_distribution"] == {}
