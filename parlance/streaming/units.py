"""Units as a stream: an extension beside the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unit_stream(spark, path: str, schema) -> DataFrame:
    """Parquet files of units as they arrive, one per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def once_delivered(units: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each unit_id once, though it is delivered again within ``delay`` of its first ingestion."""
    return units.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["unit_id"])


def ingestion_totals(units: DataFrame, window: str = "1 day") -> DataFrame:
    """(window, recording, units, seconds) by ingestion time; needs a watermark on ingested_at."""
    return units.groupBy(F.window("ingested_at", window), "recording").agg(F.count(F.lit(1)).alias("units"), F.sum(F.expr("CASE WHEN `end` > `start` THEN `end` - `start` END")).alias("seconds"))


def greedy_chunks(units: DataFrame, max_span_ms: int = 27_500, max_gap_ms: int = 3_000) -> DataFrame:
    """Closed chunks (recording, chunk, start_ms, end_ms, units) of units that arrive in time order per recording.

    A chunk comes out when a unit that it can't hold arrives. State per recording is one open chunk.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        index, first, last, n = state.get if state.exists else (0, -1, -1, 0)
        out = []
        for b in batches:
            for s, e in b.sort_values(["start_ms", "end_ms"])[["start_ms", "end_ms"]].itertuples(index=False):
                if n and (e - first > max_span_ms or s - last > max_gap_ms):
                    out.append((key[0], index, first, last, n))
                    index, n = index + 1, 0
                if not n:
                    first = s
                last, n = e, n + 1
        state.update((int(index), int(first), int(last), int(n)))
        yield pd.DataFrame(out, columns=["recording", "chunk", "start_ms", "end_ms", "units"])

    return units.groupBy("recording").applyInPandasWithState(run, "recording string, chunk int, start_ms long, end_ms long, units int", "chunk int, first long, last long, n int", "append", GroupStateTimeout.NoTimeout)
