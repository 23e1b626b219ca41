"""Streams of activity: daily counts under a watermark, and running experience per author."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events(spark, path: str) -> DataFrame:
    """The rows of a Parquet table as a stream, with the table's schema. The path goes as a pattern, as the source takes single files only so."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, scratch, name: str, mode: str) -> DataFrame:
    """Runs a stream until it has read all that is there; the rows it gave. State and progress lie in the shared folder.

    Every batch has a folder of its own, which a batch that is run again after a failure overwrites. In
    complete mode each batch is the whole result, so the last one counts.
    """

    def put(rows: DataFrame, batch: int) -> None:
        whole = mode == "complete"
        rows.write.mode("overwrite").parquet(scratch.path(name) if whole else f"{scratch.path(name)}/batch={batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path(f"{name}-progress")).trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(scratch.path(name)).select(*stream.columns)


def daily_counts(stream: DataFrame, when: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """Events per day and kind; rows later than the watermark are left out."""
    rows = stream.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return rows.groupBy(F.window(when, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def running_experience(stream: DataFrame, k: float, author: str = "user_id", when: str = "ts", key: str = "event_id", late: str = "365 days") -> DataFrame:
    """(author, key, experience) as activity comes in, for a mean gap k in days known beforehand.

    State is an author's last time and sum, and goes once the watermark has passed the author's last time
    by as much as it lags behind: an author who comes back later starts anew. A row older than the last
    one of an earlier batch adds nothing and gets the sum so far; rows of one batch may come in any order.
    """

    def step(who, parts, state):
        # Spark's own joining of result frames, one warning a batch.
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)
        if state.hasTimedOut:
            state.remove()
            return
        last, total = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(parts)).sort_values([when, key])
        t = rows[when].to_numpy().astype("datetime64[us]").astype("int64")
        seen = np.maximum.accumulate(t if last is None else np.maximum(t, last))
        gap = np.diff(seen, prepend=seen[0] if last is None else last) / 86400e6
        sums = total + np.cumsum(k * -np.expm1(-gap / k))
        state.update((int(seen[-1]), float(sums[-1])))
        state.setTimeoutTimestamp(max(int(seen[-1]) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({author: who[0], key: rows[key].to_numpy(), "experience": sums})

    rows = stream.select(author, key, F.col(when).cast("timestamp").alias(when)).withWatermark(when, late)
    return rows.groupBy(author).applyInPandasWithState(step, f"{author} long, {key} long, experience double", "last long, total double", "append", "EventTimeTimeout")
