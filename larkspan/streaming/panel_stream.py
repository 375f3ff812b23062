"""Panel counts over a stream of events, with a watermark for late ones. All counters are sums, so they merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by tumbling windows of event time; works on a batch, too."""
    source = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if source.isStreaming:
        source = source.withWatermark(ts, late)
    out = source.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(ts).alias("last"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "last")


def cooldown_stream(stream: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = 86_400, late: str = "2 days") -> DataFrame:
    """Events more than so many seconds after the last one kept of the same key, with the time kept as state."""
    import pandas as pd

    def step(k, frames, state):
        last = state.get[0] if state.exists else None
        rows = []
        for t in sorted(x for f in frames for x in f[ts].tolist()):
            if last is None or t.timestamp() - last > seconds:
                rows.append((k[0], t))
                last = t.timestamp()
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: pd.Series([r[0] for r in rows], dtype="int64"), ts: pd.Series([r[1] for r in rows], dtype="datetime64[ns]")})

    source = stream.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return source.groupBy(key).applyInPandasWithState(step, f"{key} long, {ts} timestamp", "last double", "append", "NoTimeout")
