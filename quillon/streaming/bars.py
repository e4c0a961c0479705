"""Structured Streaming forms of the bar and policy operators, with the step functions of the batch ones."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import safe_div
from quillon.operators.bars import ticks
from quillon.operators.policies import Holding, positions_of
from quillon.operators.portfolio import hysteresis_step


def stream_bars(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks, each emitted once its bucket is ``late`` behind the newest tick; later ticks are dropped by the watermark."""
    t = ticks(events).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "event_id")
    bars = t.groupBy("root", F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("quote"), F.count("*").alias("bar_count"),
    )
    return bars.select("root", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "quote", "bar_count", safe_div(F.col("quote"), F.col("volume")).alias("wap"), (F.col("bar_count") >= 2).alias("is_valid"))


def stream_held_sign(forecasts: DataFrame, enter: float, leave: float) -> DataFrame:
    """The hysteresis policy along a stream of (root, timestamp, value) in time order: one integer of state a key."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values("timestamp")
        out = []
        for v in rows["value"]:
            old = hysteresis_step(v, old, enter, leave)
            out.append(old)
        state.update((old,))
        yield rows[["root", "timestamp"]].assign(position=out)

    return forecasts.groupBy("root").applyInPandasWithState(step, "root string, timestamp timestamp, position int", "position int", "append", "NoTimeout")


def stream_thinned(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Refractory thinning along a stream of (root, timestamp): the state is the last kept time."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values("timestamp")
        keep = []
        for t in rows["timestamp"]:
            now = t.timestamp()
            keep.append(last is None or now - last >= gap_seconds)
            last = now if keep[-1] else last
        if last is not None:
            state.update((last,))
        yield rows[keep][["root", "timestamp"]]

    return events.groupBy("root").applyInPandasWithState(step, "root string, timestamp timestamp", "last double", "append", "NoTimeout")


def stream_positions(candidates: DataFrame, rules: Holding) -> DataFrame:
    """Positions along a stream of candidates (root, timestamp, scores, signal, selected, strength) in time order: position, age and prototype of each key are the state."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = tuple(state.get) if state.exists else (0, 0, -1)
        out, new = positions_of(pd.concat(frames).sort_values("timestamp"), old, rules)
        state.update(tuple(int(x) for x in new))
        yield out

    return candidates.groupBy("root").applyInPandasWithState(step, "root string, timestamp timestamp, position int, age int, prototype int", "position int, age int, prototype int", "append", "NoTimeout")
