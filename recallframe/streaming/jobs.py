"""Structured Streaming: tailing the log, windows with late data, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.session import shared_path


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Files as a stream; ``ts`` as a timestamp that can carry a watermark."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():  # one file: its folder, by name
        reader, path = reader.option("pathGlobFilter", place.getName()), str(place.getParent().toString())
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    base = shared_path(spark, "streams")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:  # the last state of every key, rewritten with each batch
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")
        query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def limited(events: DataFrame, rate: float, burst: float, idle: float = 300.0, late: str = "1 hour") -> DataFrame:
    """user_id, allowed, denied per key and batch: a token bucket kept as streaming state.

    A key's state goes once it has been idle so long that its bucket is full again
    (``idle`` seconds at least), so a returning key finds what it would have had.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (tokens, last), allowed, denied = state.get if state.exists else (float(burst), None), 0, 0
        times = sorted(t.timestamp() for pdf in batches for t in pdf["ts"])
        for t in times:
            tokens = min(burst, tokens + max(0.0, t - last) * rate) if last is not None else tokens
            last = t if last is None else max(t, last)
            if tokens >= 1:
                tokens, allowed = tokens - 1, allowed + 1
            else:
                denied += 1
        state.update((tokens, last))
        if last is not None:
            end = int(1000 * (last + max(idle, (burst - tokens) / rate)))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "denied": [denied]})

    return events.select("user_id", "ts").withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        run, "user_id long, allowed long, denied long", "tokens double, last double", "update", GroupStateTimeout.EventTimeTimeout
    )


def tail(ops: DataFrame, after: int) -> DataFrame:
    """Operations behind a cursor, for an incremental fold."""
    return ops.where(F.col("seq") > after)
