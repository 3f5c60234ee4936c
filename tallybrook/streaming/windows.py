"""Windows over the event stream, run to the end of the files at hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lake

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """Run the stream over what there is, into a table of the shared folder."""
    spark = df.sparkSession
    base = f"{lake.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").start(f"{base}/out").awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by hour and type."""
    df = _stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _drain(df.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total"), "complete")


QUERIES = {"stream_hourly": stream_hourly}
ORACLE_SQL = {"stream_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
