"""Change logs as streams: the value each signal holds, late changes dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame

OUT = "signal string, time bigint, value string, changes bigint"
STATE = "time bigint, value string, changes bigint"


def held_values(changes: DataFrame) -> DataFrame:
    """A row per signal and batch with its value after the batch.

    ``changes`` (signal string, time bigint, seq bigint, value string) may be a
    stream. A change whose time is before one already taken is late and
    dropped, as is one that repeats the value held."""
    import pandas as pd

    def update(key, batches, state):
        time, value, count = state.get if state.exists else (None, None, 0)
        for batch in batches:
            for t, v in batch.sort_values(["time", "seq"])[["time", "value"]].itertuples(index=False):
                if time is None or t >= time:
                    count += v != value
                    time, value = t, v
        if time is not None:
            state.update((int(time), value, int(count)))
            yield pd.DataFrame([(key[0], time, value, count)], columns=["signal", "time", "value", "changes"])

    return changes.groupBy("signal").applyInPandasWithState(update, OUT, STATE, "update", "NoTimeout")


def windowed_counts(changes: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Changes per signal in windows of event time ``ts``, late ones dropped by a watermark."""
    from pyspark.sql import functions as F

    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return changes.withWatermark("ts", delay).groupBy(window, "signal").agg(F.count("*").alias("n"))
