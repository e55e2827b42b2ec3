"""The given tables as flow and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_CLASSES = ("click", "error", "purchase", "signup")  # fixed order of the class index; anything else is 4
SCORE_FACTORS = (23757, 31676, 39595, 47514, 55433)
SCORE_OFFSETS = (0, 104729, 209458, 314187, 418916)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as network flows, with missing cells and infinities."""
    return flow_columns(table(spark, sf_dir, "lineitem"))


def flow_columns(lineitem: DataFrame) -> DataFrame:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return lineitem.select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey")).alias("flow_id"),
        F.concat(F.lit("10.0.0."), (supplier % 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.1.0."), (part % 250).cast("string")).alias("dst_ip"),
        F.when(part % 17 != 0, F.col("l_extendedprice")).alias("sbytes"),
        F.when(part % 19 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") * 100).alias("dbytes"),
        F.col("l_quantity").alias("spkts"),
        F.col("l_linenumber").cast("double").alias("dpkts"),
        (F.col("l_tax") + 0.0).alias("dur"),
        (supplier % 256).cast("int").alias("sttl"),
        (part % 256).cast("int").alias("dttl"),
        F.col("l_linenumber").cast("int").alias("ct_srv_src"),
        (supplier % 7).cast("int").alias("ct_state_ttl"),
        F.when(part % 23 != 0, F.col("l_linestatus")).alias("state"),
        F.concat(F.lit("p"), (part % 3).cast("string")).alias("proto"),
        F.col("l_returnflag").alias("attack_type"),
        F.col("l_shipdate").alias("ts"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a true class ``y`` and five class probabilities, ties included."""
    y = F.lit(len(EVENT_CLASSES))
    for i, name in enumerate(EVENT_CLASSES):
        y = F.when(F.col("event_type") == name, i).otherwise(y)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", y.cast("int").alias("y"))
    raw = [
        (1 + (F.col("event_id") * factor + offset) % 97 + F.when(F.col("y") == i, 60).otherwise(0)).cast("double").alias(f"r{i}")
        for i, (factor, offset) in enumerate(zip(SCORE_FACTORS, SCORE_OFFSETS))
    ]
    weighed = events.select("*", *raw)
    whole = F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3") + F.col("r4")
    return weighed.select(
        "event_id", "ts", "user_id", "y", F.array(*[F.col(f"r{i}") / whole for i in range(5)]).alias("probs")
    )


def embedding_columns(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    values = table(spark, sf_dir, "embeddings")
    shortest, longest = values.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if shortest is not None and (shortest, longest) != (n, n):
        raise ValueError(f"embeddings of {shortest} to {longest} entries; {n} expected")
    return values.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


def capture_name(number: Column, tail: Column) -> Column:
    """A capture file name: the day by the row's number, then a free tail and the metadata suffix."""
    days = F.array(
        *map(
            F.lit,
            ["Monday", "Tuesday", "Wednesday", "Thursday-Infiltration", "Thursday-Web", "Friday-DDoS",
             "Friday-Portscan", "Friday-Botnet", "Friday", "Sunday"],
        )
    )
    return F.concat(F.get(days, (number % 10).cast("int")), F.lit("-"), tail, F.lit("-no-metadata"))


def live_records(events: DataFrame) -> DataFrame:
    """Events as live records: addresses from the user, length from the value, plus event id."""
    user = F.col("user_id")
    return events.select(
        "event_id",
        F.concat(F.lit("10.0.0."), (user % 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.1.0."), (F.col("event_id") % 250).cast("string")).alias("dst_ip"),
        F.when(F.col("event_type") == "error", 17).otherwise(6).alias("protocol"),
        F.col("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
