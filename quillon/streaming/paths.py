"""Frozen inference along a stream of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from quillon.operators.pathstates import FrozenStates


def stream_forecasts(snapshots: DataFrame, frozen: FrozenStates) -> DataFrame:
    """root, timestamp, probabilities, distance for each snapshot (root, timestamp, the maps' columns) of a stream in time order. A key's state is a ring of the last ``frozen.depth`` snapshots' shares."""
    import pandas as pd

    names = frozen.names

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ring = [list(state.get[0][i : i + len(names)]) for i in range(0, len(state.get[0]), len(names))] if state.exists else []
        rows = pd.concat(frames).sort_values("timestamp")
        out = []
        for values in rows[names].itertuples(index=False):
            ring, p, _, d = frozen.step(key[0], ring, list(values))
            out.append((p.tolist(), d))
        state.update(([x for snapshot in ring for x in snapshot],))
        yield rows[["root", "timestamp"]].assign(probabilities=[p for p, _ in out], distance=[d for _, d in out])

    return snapshots.groupBy("root").applyInPandasWithState(step, "root string, timestamp timestamp, probabilities array<double>, distance double", "ring array<double>", "append", "NoTimeout")
