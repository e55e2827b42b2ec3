"""Registered queries: one or more per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import file_stem, nan_to_null, numeric_columns, ratio, string_columns
from flowsieve.functions.vectors import argmax, mean_squared_error, onehot
from flowsieve.operators import clean, encode, evaluate, profile, ranking, scale, score, split
from flowsieve.operators.features import add_flow_features
from flowsieve.plans.flow_model import fit_and_check, fit_detector, fit_flow_model, load_model, save_model
from flowsieve.plans.tables import capture_name, embedding_columns, flow_columns, flows, live_records, scores, table
from flowsieve.session import scratch_path
from flowsieve.sources import flows as sources
from flowsieve.sources import metadata
from flowsieve.streaming import detect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6
KEYS = ["flow_id", "attack_type", "ts"]
MODEL_PARTITIONS = 16  # of training tables: the flows come from one file


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def rounded(column: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, with one zero: -0.0 and 0.0 compare equal but print differently."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def _rounded_all(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = flows(spark, sf_dir)
    return clean.FlowCleaner(dropCols=["src_ip", "dst_ip"], keepCols=KEYS).fit(raw).transform(raw)


# Sources and sinks


@query
def label_from_filename(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = capture_name(F.col("p_partkey"), F.replace("p_type", F.lit(" "), F.lit("-")))
    return sources.with_capture_labels(part.select("p_partkey", name.alias("name")), F.col("name")).drop("name")


@query
def assemble_folder(spark, sf_dir):
    """Three captures with different columns, written under their day names and assembled."""
    raw = flows(spark, sf_dir)
    folder = scratch_path(spark, "captures")
    days = {"A": "Monday-WorkingHours", "N": "Thursday-Infiltration-no-metadata", "R": "Sunday-Scan-no-metadata"}
    extra = {"A": ["sbytes"], "N": ["dbytes"], "R": ["sbytes", "dttl"]}
    for flag, day in days.items():
        part = raw.where(F.col("attack_type") == flag).select("flow_id", "spkts", *extra[flag])
        part.write.parquet(f"{folder}/{day}.parquet")
    return _rounded_all(sources.assemble(spark, folder))


@query
def assemble_conflicts(spark, sf_dir):
    """Captures that disagree about types: a number in one is text in another, an integer in one a double in the next."""
    raw = flows(spark, sf_dir)
    folder = scratch_path(spark, "captures")
    forms = {
        "A": ("Monday", F.col("sttl"), F.col("ct_srv_src")), "N": ("Friday-DDoS", F.col("spkts"), F.col("dttl")),
        "R": ("Sunday-Scan", F.col("sttl"), F.col("proto")),
    }
    for flag, (day, x, mark) in forms.items():
        part = raw.where(F.col("attack_type") == flag).select("flow_id", x.alias("x"), mark.alias("mark"))
        part.write.parquet(f"{folder}/{day}.parquet")
    return sources.assemble(spark, folder)


@query
def union_by_name(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return sources.union_by_name([customers, suppliers])


@query
def dataset_metadata(spark, sf_dir):
    labelled = flows(spark, sf_dir).withColumn("source_file", F.concat(F.lit("capture-"), F.col("proto")))
    record = metadata.dataset_metadata(labelled)
    counts = F.transform(F.map_entries("class_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return record.select(
        "total_samples",
        F.col("total_features").cast("bigint").alias("total_features"),
        F.array_join(counts, ",").alias("class_distribution"),
        F.array_join("attack_types", ",").alias("attack_types"),
        F.array_join("source_files", ",").alias("source_files"),
    )


@query
def linked_metadata(spark, sf_dir):
    """The record that points to the written table of files, joined with what that table holds."""
    labelled = flows(spark, sf_dir).withColumn("source_file", F.concat(F.lit("capture-"), F.col("dst_ip")))
    record = metadata.linked_metadata(labelled, scratch_path(spark, "sources")).first()
    files = spark.read.parquet(record["source_table"]).groupBy("source").agg(F.sum("n").alias("n"))
    counts = ",".join(f"{c}={n}" for c, n in sorted(record["class_distribution"].items()))
    return files.select(
        "source", "n", F.lit(record["total_samples"]).alias("total_samples"), F.lit(record["n_source_files"]).alias("n_source_files"),
        F.lit(counts).alias("class_distribution"),
    )


@query
def split_metadata(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parts = split.three_way_split(orders, "o_orderpriority", "o_orderkey")
    record = metadata.split_metadata(parts, "o_orderpriority", {"test_size": 0.2, "val_size": 0.1, "random_state": 42})
    counts = F.transform(F.map_entries("class_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return record.select(
        "split",
        "num_samples",
        F.array_join(counts, ",").alias("class_counts"),
        rounded(F.aggregate(F.map_values("class_distribution"), F.lit(0.0), lambda a, x: a + x)).alias("share_total"),
        F.element_at("split_parameters", "val_size").alias("val_size"),
    )


@query
def holdout_metadata(spark, sf_dir):
    """The hold-out record, written as JSON and read back."""
    record = metadata.holdout_metadata(_holdout(spark, sf_dir))
    path = scratch_path(spark, "holdout-metadata")
    metadata.write_metadata(record, path)
    back = spark.read.schema(record.schema).json(path)
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return back.select("*").withColumns({c: text(c) for c in ("train_distribution", "val_distribution", "test_distribution")})


@query
def source_counts(spark, sf_dir):
    labelled = flows(spark, sf_dir).withColumn("source_file", F.concat(F.lit("capture-"), F.col("proto")))
    return metadata.source_counts(labelled)


@query
def read_write_roundtrip(spark, sf_dir):
    """Orders written as Parquet and CSV split folders and read back through the split reader."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderstatus").alias("split"))
    results = []
    for corpus, fmt in sources.CORPUS_FORMATS.items():
        path = scratch_path(spark, f"orders-{fmt}")
        sources.write_splits(orders, path, fmt)
        tables = sources.read_splits(spark, {s: f"{path}/split={s}" for s in ("F", "O", "P")}, corpus, orders.drop("split").schema)
        results += [t.withColumns({"split": F.lit(s), "format": F.lit(fmt)}) for s, t in tables.items()]
    return sources.union_by_name(results)


# Profiles


@query
def class_distribution(spark, sf_dir):
    return _rounded_all(profile.class_distribution(flows(spark, sf_dir), "attack_type"))


@query
def topk_classes(spark, sf_dir):
    return profile.class_distribution(flows(spark, sf_dir), "attack_type").select("attack_type", "n").limit(2)


@query
def sorted_classes(spark, sf_dir):
    return flows(spark, sf_dir).select("attack_type").distinct().orderBy("attack_type")


@query
def table_shape(spark, sf_dir):
    return profile.shape(flows(spark, sf_dir)).withColumn("n_columns", F.col("n_columns").cast("bigint"))


@query
def null_profile(spark, sf_dir):
    return profile.null_profile(flows(spark, sf_dir))


@query
def step_profile(spark, sf_dir):
    raw = flows(spark, sf_dir)
    dropped = clean.dedup_flows(clean.drop_identifiers(raw).select("spkts", "dpkts", "dur", "attack_type"))
    record = profile.step_profile(raw, dropped, "clean")
    return record.select(
        "operation", "rows_before", "rows_after", *[F.array_join(c, ",").alias(c) for c in ("columns_before", "columns_after", "removed_columns")]
    )


@query
def schema_diff(spark, sf_dir):
    train = flows(spark, sf_dir).select("flow_id", "sbytes", "sttl", "state")
    test = flows(spark, sf_dir).select("flow_id", "dbytes", F.col("sttl").cast("bigint").alias("sttl"), "state")
    return profile.schema_diff(train, test)


@query
def select_roles(spark, sf_dir):
    """Role of every flow column with the number of rows that hold a value."""
    raw = flows(spark, sf_dir)
    numeric, text = numeric_columns(raw), string_columns(raw, [*clean.IDENTIFIERS, "attack_type"])
    role = F.when(F.col("column").isin(clean.IDENTIFIERS), "identifier").when(F.col("column") == "attack_type", "label")
    role = role.when(F.col("column").isin(numeric), "numeric").when(F.col("column").isin(text), "categorical").otherwise("other")
    return profile.null_profile(raw).select("column", role.alias("role"), (F.col("n_rows") - F.col("n_missing")).alias("n_values"))


# Cleaning


@query
def clean_impute(spark, sf_dir):
    return _cleaned(spark, sf_dir).drop("ts")


@query
def exact_medians(spark, sf_dir):
    raw = flows(spark, sf_dir)
    medians = clean.median_values(raw, numeric_columns(raw))
    return spark.createDataFrame(sorted(medians.items()), "feature string, median double").withColumn("median", rounded("median"))


@query
def dedup_flows(spark, sf_dir):
    return clean.dedup_flows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query
def dedup_keyed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return clean.dedup_flows(rows, label="o_orderstatus", key="o_orderkey").drop("o_orderdate")


@query
def dedup_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity", "l_linenumber")
    return clean.dedup_flows(rows, "features", label="l_returnflag")


# Features


def _features(spark: SparkSession, sf_dir: str, dataset: str, names: list[str]) -> DataFrame:
    # unrounded: plain double arithmetic gives the same bits everywhere
    return add_flow_features(_cleaned(spark, sf_dir), dataset).select("flow_id", *names)


@query
def features_ratio(spark, sf_dir):
    names = ["bytes_ratio", "total_bytes", "packets_ratio", "total_packets", "avg_bytes_per_packet"]
    return _features(spark, sf_dir, "UNSW", names)


@query
def features_rate(spark, sf_dir):
    return _features(spark, sf_dir, "UNSW", ["src_bytes_per_second", "dst_bytes_per_second", "packets_per_second"])


@query
def features_interaction(spark, sf_dir):
    return _features(spark, sf_dir, "UNSW", ["service_state_interaction", "ttl_difference"])


@query
def features_cic(spark, sf_dir):
    named_so = flows(spark, sf_dir).select("flow_id", F.col("spkts").alias("Total Fwd Packets"), F.col("dur").alias("Flow Duration"))
    return add_flow_features(named_so, "CIC").select("flow_id", "fwd_packets_per_second")


# Encoders


@query
def align_schema(spark, sf_dir):
    fitted = {"spkts": "double", "sttl": "int", "state": "string", "service": "string", "proto": "string", "rate": "double"}
    raw = flows(spark, sf_dir).drop("sttl").withColumn("state", encode.categorical(F.col("state")))
    return encode.align_columns(raw, fitted, ["flow_id"])


@query
def onehot_wide(spark, sf_dir):
    raw = flows(spark, sf_dir).select("flow_id", "spkts", "proto", "state")
    return encode.OneHot(keepCols=["flow_id"]).fit(raw).transform(raw)


@query
def onehot_vector(spark, sf_dir):
    raw = flows(spark, sf_dir).select("flow_id", "proto", "state")
    hot = encode.fit_onehot_vector(raw, ["proto", "state"]).transform(raw).withColumn("hot", vector_to_array("onehot"))
    return hot.select("flow_id", *[F.col("hot")[i].alias(f"h{i}") for i in range(6)])


@query
def onehot_model_wide(spark, sf_dir):
    """A detector over a column of 250 categories, which reach the classifier as one sparse vector."""
    raw = flows(spark, sf_dir).select("flow_id", "attack_type", "spkts", "proto", F.col("dst_ip").alias("host"))
    model = fit_detector(
        raw, "attack_type", benign="N", kind="bayes", dataset="UNSW", key="flow_id", select=False, max_categories=200, partitions=MODEL_PARTITIONS
    )
    return model.transform(raw).select("flow_id", rounded(F.col("score"), 5).alias("score"))


@query
def onehot_unknown(spark, sf_dir):
    """Categories fitted on the attack classes only; those of other flows are unknown."""
    raw = flows(spark, sf_dir).select("flow_id", "attack_type", F.concat("proto", F.when(F.col("attack_type") == "N", "n").otherwise("")).alias("proto"))
    model = encode.OneHot(keepCols=["flow_id", "attack_type"], handleUnknown="ignore").fit(raw.where("attack_type <> 'N'"))
    return model.transform(raw)


@query
def label_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return encode.LabelIndex(labelCol="o_orderpriority", outputCol="y").fit(orders).transform(orders)


@query
def label_names(spark, sf_dir):
    data = scores(spark, sf_dir).withColumn("predicted", argmax(F.col("probs")))
    events = table(spark, sf_dir, "events")
    model = encode.LabelIndex(labelCol="event_type").fit(events)
    return model.names(data, "predicted", "predicted_class").select("event_id", "predicted_class")


@query
def unseen_labels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("label"))
    return encode.LabelIndex(labelCol="label").fit(orders.where("o_orderstatus = 'F'")).unseen_labels(orders)


@query
def label_onehot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    model = encode.LabelIndex(labelCol="o_orderpriority", outputCol="y").fit(orders)
    hot = model.transform(orders).withColumn("hot", onehot(F.col("y"), len(model.getOrDefault("classes"))))
    return hot.select("o_orderkey", *[F.col("hot")[i].alias(f"y{i}") for i in range(5)])


@query
def one_vs_rest(spark, sf_dir):
    rows = encode.one_vs_rest(scores(spark, sf_dir).select("event_id", "y"), "y", ["click", "error", "purchase", "signup", "view"])
    return rows.select("event_id", F.col("class_index").cast("int").alias("class_index"), "is_class")


# Scalers


def _scaled(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    cleaned = _cleaned(spark, sf_dir).select("flow_id", "sbytes", "dbytes", "spkts", "dur", "sttl")
    return scale.ColumnScaler(kind=kind, keepCols=["flow_id"]).fit(cleaned).transform(cleaned)


@query
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query
def scale_standard(spark, sf_dir):
    return _rounded_all(_scaled(spark, sf_dir, "standard"))


@query
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


# Ranking

RANKED = ["sbytes", "dbytes", "spkts", "dpkts", "dur", "sttl"]


@query
def anova_f(spark, sf_dir):
    return _rounded_all(ranking.anova_f(_cleaned(spark, sf_dir), RANKED, "attack_type"))


@query
def mutual_info(spark, sf_dir):
    return _rounded_all(ranking.mutual_info(_cleaned(spark, sf_dir), RANKED, "state"))


@query
def mutual_info_ranged(spark, sf_dir):
    """As ``mutual_info``, in value ranges."""
    return _rounded_all(ranking.mutual_info(_cleaned(spark, sf_dir), RANKED, "state", rows_per_range=5_000))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cleaned(spark, sf_dir)
    return ranking.consensus(
        ranking.anova_f(rows, RANKED, "attack_type").join(ranking.mutual_info(rows, RANKED, "attack_type"), "feature", "full_outer")
    )


@query
def rank_consensus(spark, sf_dir):
    return _rounded_all(_ranking(spark, sf_dir).drop("f_score", "mi_score"), 5)


@query
def select_topk(spark, sf_dir):
    """The three features with the highest F, in rank order, on every flow."""
    rows = _cleaned(spark, sf_dir)
    best = ranking.select_top(ranking.consensus(ranking.anova_f(rows, RANKED, "attack_type")), 3)
    return rows.select("flow_id", *[F.col(c).alias(f"feature_{i + 1}") for i, c in enumerate(best)])


@query
def rf_importance(spark, sf_dir):
    data = embedding_columns(spark, sf_dir)
    return ranking.rf_importance(data, [f"e{i}" for i in range(64)], "label")


@query
def rfe_rank(spark, sf_dir):
    data = embedding_columns(spark, sf_dir)
    return ranking.rfe_rank(data, [f"e{i}" for i in range(64)], "label", keep=30, step=2)


STUMP = {"trees": 1, "max_depth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}


def _small_counts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    n, p, q = F.col("l_linenumber"), F.col("l_partkey") % 5, F.col("l_suppkey") % 3
    return table(spark, sf_dir, "lineitem").select(*keep, n.alias("n"), p.alias("p"), q.alias("q"), (n + p >= 6).cast("double").alias("y"))


@query
def stump_importance(spark, sf_dir):
    """One split over all rows and features: the importance is that of the largest Gini gain."""
    return _rounded_all(ranking.rf_importance(_small_counts(spark, sf_dir), ["n", "p", "q"], "y", **STUMP))


@query
def stump_elimination(spark, sf_dir):
    """Elimination with the same stump, in a forced order."""
    return ranking.rfe_rank(_small_counts(spark, sf_dir), ["n", "p", "q"], "y", keep=1, **STUMP)


# Splits and weights


@query
def split_two_way(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_split(orders, "o_orderpriority", "o_orderkey", {"test": 0.2})


@query
def split_three_way(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return split.three_way_split(orders, "o_orderpriority", "o_orderkey")


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows from orders; the flows' benign class plays no part here, customers are the test."""
    train = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") < "2", 1).otherwise(0).alias("label"))
    test = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("label"))
    return split.holdout_split(train, test, "label", "o_orderkey")


@query
def split_holdout(spark, sf_dir):
    return _holdout(spark, sf_dir)


@query
def split_distribution(spark, sf_dir):
    shares = profile.split_distribution(_holdout(spark, sf_dir), "label", held_out_of={"train": "original", "validation": "original"})
    return _rounded_all(shares)


@query
def class_weights(spark, sf_dir):
    weights = split.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus")
    return _rounded_all(spark.createDataFrame(list(weights.items()), "o_orderstatus string, weight double"))


@query
def sample_weights(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    weights = split.class_weights(orders, "o_orderstatus")
    return _rounded_all(split.with_sample_weight(orders, "o_orderstatus", weights))


# Model input, training, scoring


def _sequence_text(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: F.concat_ws(":", F.round(s[0] * 100).cast("bigint").cast("string"), s[1].cast("bigint").cast("string"))), ",")


@query
def sequence_windows(spark, sf_dir):
    data = scores(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    seen = score.sequence_windows(data, ["value", "y"], "user_id", "ts", "event_id", 4)
    return seen.select("event_id", _sequence_text(F.col("sequence")).alias("sequence"))


@query
def stream_sequences(spark, sf_dir):
    """The last four events of each user, kept as state of a stream over the table."""
    events = detect.read_table_stream(spark, f"{sf_dir}/events.parquet")
    events = events.withColumn("flag", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    seen = _stream_result(spark, detect.stream_windows(events, ["value", "flag"], "user_id", "ts", "event_id", 4), "windows")
    return seen.select("event_id", _sequence_text(F.col("sequence")).alias("sequence"))


@query
def sequence_windows_hot(spark, sf_dir):
    """As ``sequence_windows_padded``, with every entity above the rows of a range."""
    events = table(spark, sf_dir, "events").withColumn("flag", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    seen = score.sequence_windows(events, ["value", "flag"], "event_type", "ts", "event_id", 3, pad=True, rows_per_range=200)
    return seen.select("event_id", _sequence_text(F.col("sequence")).alias("sequence"))


@query
def sequence_windows_padded(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("flag", F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    seen = score.sequence_windows(events, ["value", "flag"], "event_type", "ts", "event_id", 3, pad=True)
    return seen.select("event_id", _sequence_text(F.col("sequence")).alias("sequence"))


@query
def classifier_scores(spark, sf_dir):
    data = score.assemble_vector(embedding_columns(spark, sf_dir), [f"e{i}" for i in range(64)])
    model = score.train_classifier(data, "label", "logistic")
    scored = score.predict(data, model)
    return scored.select("vec_id", "predicted", rounded(F.array_max("probs"), 3).alias("probability"))


@query
def model_choice(spark, sf_dir):
    parts = split.stratified_split(embedding_columns(spark, sf_dir), "label", "vec_id", {"val": 0.3})
    data = score.assemble_vector(parts, [f"e{i}" for i in range(64)]).select("label", "split", "features")
    candidates = {"logistic": ("logistic", {}), "forest": ("forest", {"seed": 42})}
    _, choice = score.choose_model(candidates, data.where("split = 'train'"), data.where("split = 'val'"), "label")
    return choice


@query
def model_folds(spark, sf_dir):
    """Naive Bayes against a single split over three folds: macro F1 of each, and the choice."""
    rows = _small_counts(spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.withColumn("key", F.concat_ws("-", *[F.col(c).cast("string") for c in rows.columns[:4]]))
    data = score.assemble_vector(rows, ["n", "p", "q"])
    stump = {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}
    _, choice = score.choose_over_folds({"bayes": ("bayes", {}), "stump": ("forest", stump)}, data, "y", "key")
    return _rounded_all(choice, 5)


@query
def sequence_bayes(spark, sf_dir):
    """Naive Bayes over the windows of a user's last two events."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", (F.col("event_id") % 5).alias("a"), (F.col("event_id") % 3).alias("b"), (F.col("event_type") == "click").cast("double").alias("y")
    )
    windows = score.sequence_windows(events, ["a", "b"], "user_id", "ts", "event_id", 2)
    data = score.PackSequence(windowSize=2, width=2).transform(windows)
    scored = score.predict(data, score.train_classifier(data, "y", "bayes"))
    return scored.select("event_id", rounded(F.element_at("probs", 1), 5).alias("p0"))


@query
def reconstruction_score(spark, sf_dir):
    data = score.array_vector(table(spark, sf_dir, "embeddings"), "embedding")
    model = score.fit_reconstruction(data)
    return score.reconstruction_score(data, model).select("vec_id", rounded("reconstruction_error").alias("reconstruction_error"))


@query
def reconstruction_full(spark, sf_dir):
    """With as many components as entries nothing is lost: the error is zero on every row."""
    data = score.array_vector(table(spark, sf_dir, "embeddings"), "embedding")
    model = score.fit_reconstruction(data, components=64)
    rebuilt = score.rebuilt_rows(data, model)
    error = mean_squared_error(F.col("values"), F.col("rebuilt"))
    return rebuilt.select("vec_id", rounded(error).alias("rebuilt_error")).join(
        score.reconstruction_score(data, model).select("vec_id", rounded("reconstruction_error").alias("reconstruction_error")), "vec_id"
    )


@query
def reconstruction_pair(spark, sf_dir):
    """Two columns and one component: the mean error is half the smaller eigenvalue of their covariance."""
    pair = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("pair"))
    data = score.array_vector(pair, "pair")
    scored = score.reconstruction_score(data, score.fit_reconstruction(data, components=1))
    return scored.agg(F.count("*").alias("n"), rounded(F.avg("reconstruction_error"), 5).alias("mean_error"))


@query
def bayes_scores(spark, sf_dir):
    """Multinomial naive Bayes over three counts: class probabilities in closed form."""
    data = score.assemble_vector(_counts(spark, sf_dir), ["a", "b", "c"])
    scored = score.predict(data, score.train_classifier(data, "y", "bayes"))
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(F.element_at("probs", 1), 5).alias("p0"))


@query
def joint_model_loss(spark, sf_dir):
    """Classifier and reconstruction fitted together, and the joint loss of what they give."""
    data = score.assemble_vector(_counts(spark, sf_dir), ["a", "b"])
    model = score.fit_joint(data, "y", "bayes", components=1)
    rows = score.joint_rows(data, model).withColumn("y", F.col("y").cast("int"))
    return _rounded_all(evaluate.joint_loss(rows, "y", "probs", "values", "rebuilt"), 5)


@query
def joint_detector(spark, sf_dir):
    """Class and reconstruction head in one detector, saved and read back: both scores of every row."""
    raw = flows(spark, sf_dir).select("flow_id", "attack_type", "spkts", "ct_srv_src")
    model = fit_detector(
        raw, "attack_type", benign="N", kind="bayes", components=1, dataset="UNSW", key="flow_id", select=False, dedup="none", partitions=MODEL_PARTITIONS
    )
    path = scratch_path(spark, "detector")
    save_model(model, path)
    scored = load_model(path).transform(raw)
    return scored.select("flow_id", rounded(F.col("score"), 5).alias("score"), rounded(F.col("reconstruction_error"), 5).alias("reconstruction_error"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("a"), F.col("l_linenumber").cast("double").alias("b"),
        (F.col("l_partkey") % 7).cast("double").alias("c"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("y"),
    )


@query
def vector_sums(spark, sf_dir):
    """The packed vector holds its columns in order."""
    packed = score.assemble_vector(_counts(spark, sf_dir), ["c", "a", "b"])
    parts = vector_to_array("features")
    return packed.groupBy("y").agg(*[F.sum(parts[i]).alias(f"s{i}") for i in range(3)])


@query
def fit_checks(spark, sf_dir):
    """The flow model fitted on the training part, applied to all three, and what the checks report."""
    raw = flows(spark, sf_dir)
    rows = split.three_way_split(raw, "attack_type", "flow_id")
    parts = {name: rows.where(F.col("split") == name).drop("split") for name in ("train", "test", "val")}
    checks = fit_and_check(parts, "attack_type", dataset="UNSW", key="flow_id", select=False, partitions=MODEL_PARTITIONS).checks
    return checks.select("part", "n_rows", "n_missing", "same_schema", "unseen", rounded("largest_share").alias("largest_share"))


def _value_odds():
    """A stand-in for a model of another library: probability by the value, loaded in the task."""
    return lambda x: np.column_stack([1 / (1 + x[:, 0]), x[:, 0] / (1 + x[:, 0])])


@query
def batch_scores(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    scored = score.predict_batches(events, ["value"], _value_odds)
    return scored.select("event_id", argmax(F.col("probs")).alias("predicted"), F.col("probs")[0].alias("p0"), F.col("probs")[1].alias("p1"))


@query
def alerts(spark, sf_dir):
    records = live_records(table(spark, sf_dir, "events"))
    scaled = scale.ColumnScaler(keepCols=["event_id", "protocol"]).fit(records).transform(records).withColumnRenamed("value", "score")
    hits = score.alerts(scaled, context=["event_id"])
    return hits.select(
        "level",
        "message",
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        F.get_json_object("context", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("context", "$.src_ip").alias("src_ip"),
    )


# Evaluation


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("predicted", argmax(F.col("probs")))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).withColumn("rebuilt", F.transform("probs", lambda p: F.floor(p * 10) / 10))


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(_predicted(spark, sf_dir), "y", "predicted", list(range(6))).select("true_class", "predicted_class", "n")


@query
def confusion_pct(spark, sf_dir):
    return _rounded_all(evaluate.confusion(_predicted(spark, sf_dir), "y", "predicted").drop("n"))


@query
def classification_report(spark, sf_dir):
    return _rounded_all(evaluate.classification_report(_predicted(spark, sf_dir), "y", "predicted"))


@query
def accuracy_macro_f1(spark, sf_dir):
    return _rounded_all(evaluate.macro_f1(_predicted(spark, sf_dir), "y", "predicted"))


@query
def threshold_metrics(spark, sf_dir):
    return _rounded_all(evaluate.threshold_metrics(scores(spark, sf_dir), "y", "probs"))


@query
def topk_accuracy(spark, sf_dir):
    return _rounded_all(evaluate.topk_accuracy(scores(spark, sf_dir), "y", "probs"))


@query
def joint_loss(spark, sf_dir):
    return _rounded_all(evaluate.joint_loss(_rebuilt(spark, sf_dir), "y", "probs", "probs", "rebuilt"))


@query
def evaluation_summary(spark, sf_dir):
    return _rounded_all(evaluate.evaluation_summary(_rebuilt(spark, sf_dir), "y", "probs", "probs", "rebuilt"))


@query
def roc_points(spark, sf_dir):
    return _rounded_all(evaluate.roc_points(scores(spark, sf_dir), "y", "probs"))


@query
def roc_points_pruned(spark, sf_dir):
    return _rounded_all(evaluate.roc_points(scores(spark, sf_dir), "y", "probs", prune=True))


@query
def auc_ovr(spark, sf_dir):
    return _rounded_all(evaluate.auc_ovr(scores(spark, sf_dir), "y", "probs"))


@query
def roc_points_ranged(spark, sf_dir):
    """As ``roc_points``, in value ranges."""
    return _rounded_all(evaluate.roc_points(scores(spark, sf_dir), "y", "probs", rows_per_range=100))


@query
def auc_ovr_ranged(spark, sf_dir):
    """As ``auc_ovr``, in value ranges."""
    return _rounded_all(evaluate.auc_ovr(scores(spark, sf_dir), "y", "probs", rows_per_range=100))


@query
def auc_summary(spark, sf_dir):
    return _rounded_all(evaluate.auc_summary(scores(spark, sf_dir), "y", "probs"))


@query
def binned_auc(spark, sf_dir):
    return _rounded_all(evaluate.binned_auc(scores(spark, sf_dir), "y", "probs"))


@query
def feature_histogram(spark, sf_dir):
    return _rounded_all(evaluate.feature_histogram(table(spark, sf_dir, "events"), "value", "event_type", 40))


@query
def feature_histogram_gaps(spark, sf_dir):
    """A column with infinities: they are left out."""
    return _rounded_all(evaluate.feature_histogram(flows(spark, sf_dir), "dbytes", "attack_type", 20))


@query
def feature_density(spark, sf_dir):
    return _rounded_all(evaluate.feature_density(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"))


@query
def feature_density_outlier(spark, sf_dir):
    """Many distinct values, and one of a single label far beyond the others."""
    far = (F.col("l_orderkey") == 1) & (F.col("l_linenumber") == 1)
    price = F.when(far, 1e6).otherwise(F.col("l_extendedprice").cast("double") / 1000)
    return _rounded_all(evaluate.feature_density(table(spark, sf_dir, "lineitem").withColumn("price", price), "price", "l_returnflag"))


@query
def attack_timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("attack", F.when(F.col("event_type") == "error", 1).otherwise(0))
    line = evaluate.attack_timeline(events, "ts", "attack")
    return _rounded_all(line.withColumn("hour", F.col("hour").cast("timestamp_ntz")))


# Scalar functions


@query
def scalar_strings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_type", F.lit(".parquet"))
    return part.select(
        "p_partkey",
        file_stem(path).alias("stem"),
        F.element_at(F.split(F.replace("p_brand", F.lit("Brand"), F.lit("")), "#"), -1).alias("tail"),
        F.col("p_type").contains("STEEL").alias("has_token"),
    )


@query
def scalar_math(spark, sf_dir):
    data = scores(spark, sf_dir)
    return data.select(
        "event_id",
        F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"),
        argmax(F.col("probs")).alias("predicted"),
        rounded(F.abs(F.col("probs")[0] - F.col("probs")[1])).alias("difference"),
        rounded(ratio(F.col("probs")[0], F.col("y").cast("double"))).alias("safe_ratio"),
        nan_to_null(F.when(F.col("y") == 0, F.lit(float("nan"))).otherwise(F.col("y").cast("double"))).alias("no_nan"),
    )


@query
def scalar_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    record = score.log_records(events, "INFO", F.concat(F.lit("event "), "event_type"), "timestamp", ["event_id", "event_type", "props"])
    return record.select(
        "level",
        "message",
        F.get_json_object("context", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object(F.get_json_object("context", "$.props"), "$.k").cast("bigint").alias("k"),
    )


# Streaming


def _stream_result(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    detect.write_stream(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _record_texts(events: DataFrame) -> DataFrame:
    """Records as JSON text; every error event with an odd id arrives cut off."""
    records = live_records(events)
    text = F.to_json(F.struct("event_id", "src_ip", "dst_ip", "protocol", "value", "timestamp"))
    broken = (F.col("protocol") == 17) & (F.col("event_id") % 2 == 1)
    return records.select(F.when(broken, F.substring(text, 1, 30)).otherwise(text).alias("value"))


def _text_schema():
    return detect.T.StructType(
        [
            detect.T.StructField("event_id", detect.T.LongType()),
            *detect.RECORD_SCHEMA.fields[:3],
            detect.T.StructField("value", detect.T.DoubleType()),
            detect.RECORD_SCHEMA["timestamp"],
        ]
    )


@query
def stream_alerts(spark, sf_dir):
    """Score with the state fitted on the batch table, threshold, message."""
    path = f"{sf_dir}/events.parquet"
    history = live_records(spark.read.parquet(path))
    model = scale.ColumnScaler(keepCols=["event_id", "protocol"]).fit(history)
    stream = live_records(detect.read_table_stream(spark, path))
    hits = detect.score_stream(stream, model, score="value")
    result = _stream_result(spark, hits, "alerts")
    return result.select("level", "message", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query
def stream_dead_scores(spark, sf_dir):
    """A stream of flows through a model that hasn't seen protocol p2: the others are scored, p2 goes aside."""
    train = flows(spark, sf_dir).where("proto <> 'p2'")
    model = fit_flow_model(train, "attack_type", key="flow_id", select=False, unknown="error")
    live = flow_columns(detect.read_table_stream(spark, f"{sf_dir}/lineitem.parquet"))
    folder = scratch_path(spark, "divided")
    outputs = {
        "scored": lambda batch: detect.divide(batch, model)[0].select("flow_id"),
        "dead_letter": lambda batch: detect.scoring_letters(detect.divide(batch, model)[1]),
    }
    detect.write_batches(live, outputs, folder, f"{folder}/checkpoint").awaitTermination()
    scored = spark.read.parquet(f"{folder}/scored").agg(F.lit("scored").alias("message"), F.count("*").alias("n"), F.countDistinct("flow_id").alias("n_flows"))
    dead = spark.read.parquet(f"{folder}/dead_letter").withColumn("flow_id", F.get_json_object("record", "$.flow_id"))
    return scored.unionByName(dead.groupBy("message").agg(F.count("*").alias("n"), F.countDistinct("flow_id").alias("n_flows")))


@query
def stream_dead_letter(spark, sf_dir):
    """Good records to one table, broken ones aside with the error text; the stream goes on."""
    stream = _record_texts(detect.read_table_stream(spark, f"{sf_dir}/events.parquet")).withColumnRenamed("value", "record")
    parsed = detect.parse_records(stream, _text_schema(), "record")
    folder = scratch_path(spark, "records")
    outputs = {
        "good": lambda batch: batch.where("error is null").select("event_id", "src_ip", "value"),
        "dead_letter": lambda batch: detect.dead_letters(batch, "record"),
    }
    detect.write_batches(parsed, outputs, folder, f"{folder}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{folder}/good").groupBy().agg(F.count("*").alias("n"), F.sum("event_id").cast("bigint").alias("ids"))
    dead = spark.read.parquet(f"{folder}/dead_letter").groupBy("message").agg(F.count("*").alias("n"))
    return good.select(F.lit("good").alias("message"), "n", "ids").unionByName(
        dead.select("message", "n", F.lit(None).cast("bigint").alias("ids"))
    )


@query
def stream_timeline(spark, sf_dir):
    stream = detect.read_table_stream(spark, f"{sf_dir}/events.parquet")
    attacks = stream.withColumn("attack", F.when(F.col("event_type") == "error", 1).otherwise(0))
    result = _stream_result(spark, detect.timeline_stream(attacks, "ts", "attack"), "timeline")
    return _rounded_all(result.withColumn("hour", F.col("hour").cast("timestamp_ntz")))


@query
def stream_dedup(spark, sf_dir):
    """The event file replayed: every event arrives twice and is kept once."""
    path = f"{sf_dir}/events.parquet"
    twice = detect.read_table_stream(spark, path).union(detect.read_table_stream(spark, path))
    result = _stream_result(spark, detect.dedup_stream(twice, "event_id", "ts").select("event_id", "event_type", "value"), "dedup")
    return result


@query
def stream_alert_rate(spark, sf_dir):
    stream = live_records(detect.read_table_stream(spark, f"{sf_dir}/events.parquet"))
    hits = stream.where("value > 50")
    result = _stream_result(spark, detect.alert_rate_stream(hits, "timestamp", "src_ip"), "rate")
    return result.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# The fitted flow model


def _class_means(df: DataFrame, label: str) -> DataFrame:
    """Mean of every numeric column per class, in long form, from one aggregate."""
    names = numeric_columns(df, [label])
    means = df.groupBy(label).agg(*[F.avg(F.col(c)).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), rounded(c).alias("mean")) for c in names])
    return means.select(label, F.inline(cells))


@query
def flow_model_scaled_means(spark, sf_dir):
    """Clean, drop duplicates, derive, encode and scale; then the class means of every feature."""
    raw = flows(spark, sf_dir)
    model = fit_flow_model(raw, "attack_type", dataset="UNSW", key="flow_id", select=False, partitions=MODEL_PARTITIONS)
    return _class_means(model.transform(raw), "attack_type")


@query
def flow_model_end_to_end(spark, sf_dir):
    """As above, with the features chosen by F and mutual information."""
    raw = flows(spark, sf_dir)
    model = fit_flow_model(raw, "attack_type", dataset="UNSW", key="flow_id", k=8, selector={"useAnova": True}, partitions=MODEL_PARTITIONS)
    return _class_means(model.transform(raw), "attack_type")


@query
def flow_model_save_load(spark, sf_dir):
    raw = flows(spark, sf_dir)
    model = fit_flow_model(raw, "attack_type", dataset="UNSW", key="flow_id", select=False, partitions=MODEL_PARTITIONS)
    path = scratch_path(spark, "model")
    save_model(model, path)
    both = {"fitted": model, "reloaded": load_model(path)}
    rows = [
        m.transform(raw).agg(F.count("*").alias("n"), *[rounded(F.avg(c)).alias(c) for c in ("bytes_ratio", "ttl_difference", "proto_p1")])
        .withColumn("model", F.lit(name))
        for name, m in both.items()
    ]
    return rows[0].unionByName(rows[1])


def _detector(raw: DataFrame):
    addresses = ["src_ip", "dst_ip", "ts"]
    return fit_detector(
        raw, "attack_type", benign="N", dataset="UNSW", key="flow_id", keep=addresses, select=False, balanced=True,
        classifier={"seed": 42}, partitions=MODEL_PARTITIONS,
    )


@query
def detector_scores(spark, sf_dir):
    """Flow model and forest in one model: confusion of the predicted classes."""
    raw = flows(spark, sf_dir)
    return evaluate.confusion(_detector(raw).transform(raw), "attack_type", "predicted_class", ["A", "N", "R"])


@query
def stream_detector_agreement(spark, sf_dir):
    """Source addresses whose alerts differ between the stream and the table."""
    counts = stream_detector(spark, sf_dir)
    return counts.agg(F.count_if(~F.col("n_stream").eqNullSafe(F.col("n_batch"))).alias("n_differing"), (F.count("*") > 0).alias("any_alert"))


@query
def stream_detector(spark, sf_dir):
    """The same model on the flows as a stream and as a table: alert rows per source address."""
    raw = flows(spark, sf_dir)
    model = _detector(raw)
    path = f"{sf_dir}/lineitem.parquet"
    live = flow_columns(detect.read_table_stream(spark, path)).drop("attack_type")
    streamed = _stream_result(spark, detect.score_stream(live, model, threshold=2 / 3, time="ts"), "detector")
    batch = score.alerts(model.transform(raw), threshold=2 / 3, time="ts")
    source = F.get_json_object("context", "$.src_ip").alias("src_ip")
    counts = [d.groupBy(source).agg(F.count("*").alias(name)) for d, name in ((streamed, "n_stream"), (batch, "n_batch"))]
    return counts[0].join(counts[1], "src_ip", "full_outer")
