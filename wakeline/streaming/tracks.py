"""Tracks as streams: the rule of destutter with a state for each track. An extension; batch tracks do not need it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def destutter_stream(positions: DataFrame) -> DataFrame:
    """Positions (track_id, time_ns, lat, lon) that differ from the one before in their track, across micro-batches.

    A micro-batch's rows are taken in order of time; rows that come late, with a time before the last one's, are
    compared with it as if they came after. Rows with a null are left out.
    """
    kind = dict(positions.dtypes)["track_id"]

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).dropna().sort_values(["time_ns", "lat", "lon"])
        before = state.get if state.exists else (None, None)
        lat, lon = rows["lat"].shift(1), rows["lon"].shift(1)
        if len(rows):
            if before[0] is not None:
                lat.iloc[0], lon.iloc[0] = before
            state.update((float(rows["lat"].iloc[-1]), float(rows["lon"].iloc[-1])))
        yield rows[~((rows["lat"] == lat) & (rows["lon"] == lon))]

    return positions.select("track_id", "time_ns", "lat", "lon").groupBy("track_id").applyInPandasWithState(
        changed, f"track_id {kind}, time_ns long, lat double, lon double", "lat double, lon double", "append", GroupStateTimeout.NoTimeout
    )
