"""What fits write, and how they are dealt, as the table grows."""

import os

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import ranking, score
from flowsieve.plans import flow_model
from flowsieve.session import shared_dir


def _flows(spark, n=240):
    rows = [(f"f{i}", float(i % 7), float(i % 3), "tcp" if i % 2 else "udp", "A" if i % 7 > 3 else "BENIGN") for i in range(n)]
    return spark.createDataFrame(rows, "flow_id string, spkts double, dur double, proto string, attack_type string")


def _folders(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _new(spark, before):
    return sorted(name.rsplit("-", 1)[0] for name in _folders(spark) - before)


def test_flow_model_writes_the_plain_rows_once_and_unspread(spark):
    before = _folders(spark)
    flow_model.fit_flow_model(_flows(spark), "attack_type", key="flow_id", select=False, partitions=5)
    assert _new(spark, before) == ["training-rows"]
    (name,) = _folders(spark) - before
    rows = spark.read.parquet(f"{shared_dir(spark)}/{name}")
    assert rows.columns == ["spkts", "dur", "proto", "attack_type"] and rows.count() == 42


def test_detector_looks_for_duplicates_once(spark):
    before = _folders(spark)
    flow_model.fit_detector(_flows(spark), "attack_type", key="flow_id", select=False, partitions=2, classifier={"numTrees": 2})
    assert _new(spark, before) == ["training-rows", "training-vectors"]


def test_large_detector_makes_vectors_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(flow_model, "SPREAD_ROWS", 100)
    before = _folders(spark)
    model = flow_model.fit_detector(_flows(spark), "attack_type", key="flow_id", select=False, partitions=2, classifier={"numTrees": 5})
    assert _new(spark, before) == ["training-rows"]
    scored = model.transform(_flows(spark))
    assert scored.where(F.col("predicted_class") != F.col("attack_type")).count() == 0


def test_forests_of_middling_tables_use_more_than_two_tasks():
    assert [ranking.forest_parts(n) for n in (0, 2_000, 16_000, 24_000, 100_000, 700_000, 40_000_000)] == [2, 2, 2, 3, 12, 16, 20]


def test_dense_vectors_refuse_gaps(spark):
    pack = flow_model.PackFeatures(inputCols=["a", "b c"], dense=True)
    for gap in (None, float("nan")):
        with pytest.raises(Exception, match="missing value"):
            pack.transform(spark.createDataFrame([(0.0, gap)], "a double, `b c` double")).collect()
    assert pack.transform(spark.createDataFrame([(0.0, 2.0)], "a double, `b c` double")).first()["features"].toArray().tolist() == [0.0, 2.0]


def test_alerts_ask_the_classifier_once_a_row(spark):
    """The condition on the score stays above the model; below it, every step would be written out in the filter anew."""
    flows = _flows(spark).withColumns({"src_ip": F.lit("a"), "dst_ip": F.lit("b"), "ts": F.lit(0)})
    model = flow_model.fit_detector(flows, "attack_type", key="flow_id", keep=["src_ip", "dst_ip", "ts"], select=False, classifier={"numTrees": 5})
    hits = score.alerts(model.transform(flows), threshold=0.5, time="ts")
    lines = hits._jdf.queryExecution().executedPlan().toString().split("\n")
    filters = [line for line in lines if "Filter" in line]
    assert filters and not [line for line in filters if "UDF(" in line]
    assert sum("Generate explode" in line for line in lines) == 1
    assert hits.count() == flows.where("attack_type = 'A'").count()
