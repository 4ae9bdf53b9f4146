"""Streaming forms of the stateful operators, for acquisitions that arrive as files. Each takes a streaming (or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """Parquet files as they arrive, at most so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, begin, end, n): bursts of events no further apart than the gap. Events later than the watermark are dropped."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def tiles(events: DataFrame, key: str, ts: str, value: str, width: str = "1 second", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, begin, n, mean, peak) of tumbling (or sliding) tiles."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(F.abs(value)).alias("peak")).select(key, F.col("w.start").alias("begin"), "n", "mean", "peak")


def first_of_each(events: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def debounced(onsets: DataFrame, key: str, at: str, least: int) -> DataFrame:
    """(key, at): onsets at least `least` after the last one kept, the last one being the key's whole state. Onsets of a key must
    arrive in order of micro-batches; within one they are put in order."""

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for x in sorted(int(v) for pdf in pdfs for v in pdf[at]):
            if last is None or x - last >= least:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), at: kept})

    kind = onsets.schema[key].dataType.simpleString()
    return onsets.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} long", "last long", "append", GroupStateTimeout.NoTimeout)
