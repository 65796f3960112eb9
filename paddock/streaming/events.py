"""Streams of events: windowed aggregates, stream-static as-of cut-offs, idempotent round sinks and status windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, t: str, key: list[str], x: str, length: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window and key: rows, mean, largest value. Rows later than the watermark don't count."""
    return events.withWatermark(t, late).groupBy(F.window(t, length), *key).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.max(x).alias("most")).select(F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), *key, "n", "mean", "most")


def per_lap(samples: DataFrame, t: str, key: list[str], speed: str, throttle: str, brake: str, late: str = "10 minutes") -> DataFrame:
    """Per key (a driver's lap): samples, mean and greatest speed, shares of full throttle and of braking. In append mode a lap comes
    out once the watermark has passed the window of a day that holds it."""
    on = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    agg = samples.withWatermark(t, late).groupBy(F.window(t, "1 day"), *key).agg(F.count("*").alias("samples"), F.avg(speed).alias("speed_mean"), F.max(speed).alias("speed_max"), on(F.col(throttle) >= 95).alias("full_throttle_share"), on(F.col(brake) >= 0.5).alias("brake_share"))
    return agg.drop("window")


def before_cutoff(events: DataFrame, cutoffs: DataFrame, key: list[str], t: str, cut: str = "cutoff") -> DataFrame:
    """Stream rows strictly before their key's cut-off (a static table)."""
    return events.join(cutoffs, key).filter(F.col(t) < F.col(cut))


def aligned(samples: DataFrame, laps: DataFrame, key: list[str], t: str, start: str, end: str, late: str = "10 minutes") -> DataFrame:
    """Samples with the lap whose interval holds them; both sides are streams with watermarks, so state stays bounded."""
    s = samples.withWatermark(t, late).alias("s")
    laps_ = laps.withWatermark(end, late).alias("l")
    same = [F.col(f"s.{k}") == F.col(f"l.{k}") for k in key]
    within = (F.col(f"s.{t}") >= F.col(f"l.{start}")) & (F.col(f"s.{t}") < F.col(f"l.{end}"))
    on = within
    for c in same:
        on = on & c
    return s.join(laps_, on).select("s.*", *[F.col(f"l.{c}") for c in laps.columns if c not in key])


def status_windows(events: DataFrame, key: str, t: str, code: str, opens: list[str], closes: list[str]) -> DataFrame:
    """Windows that an opening code begins and the next closing code ends, as they close. State: one open window a key."""
    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, since = state.get if state.exists else ("", None)
        out = []
        for row in pd.concat(list(batches)).sort_values(t).itertuples(index=False):
            value, at = getattr(row, code), getattr(row, t)
            if kind and value in closes and at > since:
                out.append((group[0], kind, since, at))
                kind, since = "", None
            if not kind and value in opens:
                kind, since = value, at
        if kind:
            state.update((kind, since))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "kind", "t0", "t1"])

    narrow = events.select(F.col(key).cast("string").alias(key), F.col(t).cast("timestamp").alias(t), code)
    return narrow.groupBy(key).applyInPandasWithState(step, "key string, kind string, t0 timestamp, t1 timestamp", "kind string, since timestamp", "append", GroupStateTimeout.NoTimeout)


def into_rounds(stream: DataFrame, path: str, checkpoint: str):
    """A sink that replaces the (year, round) partitions that a batch touches: a repeated batch leaves the same table."""
    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "round").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
