"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from ..streaming import events as streams
from .registry import query, table, tidy


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The result after all input, as a table that the stream's last batch wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("""SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS t0, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY 1, 2""")
def stream_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _finished(streams.windowed(_stream(spark, sf_dir), "ts", ["event_type"], "value"), "windowed", "complete")
    return tidy(out.select(F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("t0"), "event_type", "n", "mean", "most"))


@query("""SELECT e.event_id FROM events e JOIN (SELECT user_id, max(ts) AS cut FROM events GROUP BY 1) c ON e.user_id = c.user_id AND e.ts < c.cut""")
def stream_before_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("cutoff"))
    return _finished(streams.before_cutoff(_stream(spark, sf_dir), cuts, ["user_id"], "ts").select("event_id"), "before", "append")
