"""Recursions over streams: a local-level filter and windowed moments with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, t long, level double, variance double, innovation double"
STATE = "t long, level double, variance double"


def local_level_stream(stream: DataFrame, key: str, order: str, y: str, obs_variance: float, level_variance: float, start_variance: float = 1e6) -> DataFrame:
    """The local-level Kalman filter over a stream, one state (three numbers) a key; rows
    of a micro-batch are taken in the order of ``order``."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, level, variance = state.get if state.exists else (0, 0.0, start_variance)
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for v in rows["y"]:
            if t:
                variance += level_variance
            f = variance + obs_variance
            gap = v - level
            level += variance / f * gap
            variance -= variance * variance / f
            out.append((keys[0], t, level, variance, gap))
            t += 1
        state.update((t, level, variance))
        yield pd.DataFrame(out, columns=["key", "t", "level", "variance", "innovation"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("ord"), F.col(y).cast("double").alias("y"))
    return rows.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_moments(stream: DataFrame, ts: str, y: str, size: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, variance, skewness and kurtosis by (sliding) time window; rows later
    than ``late`` are dropped by the watermark."""
    x = F.col(y).cast("double")
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        stream.withWatermark(ts, late).groupBy(window.alias("w"), *by)
        .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "variance", "skewness", "kurtosis")
    )
