"""Readers of the tables and the operator inputs made from them; sinks for results and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that stand for a sensor's features before any was seen, by number of the feature; all others are 0. Fixed values.
SENSOR_DEFAULTS = {
    1: 3189.888, 2: 2292.732, 3: 2905.604, 4: 2028.754, 5: 1384.5, 6: 690.404, 7: 1559.87, 8: 1078.064, 9: 9322.3,
    10: 9722.882, 11: 9119.24, 12: 9501.362, 13: 10114.234, 14: 8901.412, **{k: 1.846 for k in range(15, 27)}, 27: 138.45,
    38: 138.45, 39: 55.38, 40: 3.692, 50: 915.616, 51: 9165.39, 52: 184.6, 53: 46.15, 63: 114.452, 64: 40.612,
    75: 930.384, 76: 2377.648,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = False) -> DataFrame:
    """Delimited rows with a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def stream(spark: SparkSession, path: str, schema: str, *, form: str = "parquet", files_a_batch: int = 1) -> DataFrame:
    """A folder of files as a stream."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)


def drain(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Write what a stream has now to Parquet and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three features, keyed by return flag, weighted by quantity."""
    t = table(spark, sf_dir, "lineitem")
    data = F.array(F.col("l_quantity") / 7, F.col("l_extendedprice") / 9973, F.col("l_discount") / 0.7)
    return t.select(F.col("l_returnflag").alias("pid"), F.col("l_orderkey").alias("seq"), F.array(*map(F.lit, range(3))).alias("slice"), data.alias("data"), F.array_repeat("l_quantity", 3).alias("weight"))


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two features in the order of event_id, keyed by type."""
    t = table(spark, sf_dir, "events")
    data = F.array(F.col("value") / 97, ((F.col("event_id") * 7) % 11) / 13.0)
    return t.select(F.col("event_type").alias("pid"), F.col("event_id").alias("seq"), "ts", F.array(F.lit(0), F.lit(1)).alias("slice"), data.alias("data"), F.array(F.col("user_id") % 5 + 1.0, F.lit(2.0)).alias("weight"))


def event_log(spark: SparkSession, sf_dir: str, delay: int = 3, classes: bool = False, slope: float = 0.0) -> DataFrame:
    """Features at seq 2 i and their label at seq 2 (i + delay) + 1, in models by event type; slope: of the second feature in labels."""
    t = table(spark, sf_dir, "events")
    x = F.array(F.col("value") / 97, (F.col("event_id") % 7 - 3) / 3.0)
    y = F.when(F.col("user_id") % 3 == 0, -1.0).otherwise(1.0) if classes else F.col("value") / 53 - (F.col("user_id") % 5) / 3.7
    y = y + slope * x[1] if slope else y
    rows = t.select(F.col("event_type").alias("model_key"), F.col("event_id").alias("idx"), x.alias("x"), y.alias("y"))
    seen = rows.select("model_key", (F.col("idx") * 2).alias("seq"), F.lit("x").alias("kind"), "idx", F.col("x").alias("features"), F.lit(None).cast("double").alias("label"))
    told = rows.select("model_key", ((F.col("idx") + delay) * 2 + 1).alias("seq"), F.lit("y").alias("kind"), "idx", F.lit(None).cast("array<double>").alias("features"), F.col("y").alias("label"))
    return seen.unionByName(told)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed scalar series of event values."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("key"), F.col("event_id").alias("seq"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as double vectors, dealt to four keys."""
    t = table(spark, sf_dir, "embeddings")
    data = F.transform("embedding", lambda x: x.cast("double"))
    return t.select((F.col("vec_id") % 4).cast("int").alias("pid"), F.col("vec_id").alias("seq"), data.alias("data"), "label")
