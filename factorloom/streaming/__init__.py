"""Incremental factors over a stream of panel rows.

Panel rows arrive by date; each instrument keeps its last rows as state, so that windowed
factors of new rows are computed without the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_mean_stream(rows: DataFrame, window: int, column: str = "close") -> DataFrame:
    """(datetime, instrument, value): the mean of the last ``window`` rows, NULL until there are so many."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values("datetime")
        values = kept + new[column].tolist()
        mean = pd.Series(values, dtype=float).rolling(window).mean().iloc[len(kept) :]
        state.update((values[-(window - 1) :] if window > 1 else [],))
        yield pd.DataFrame({"datetime": new["datetime"].to_numpy(), "instrument": key[0], "value": mean.to_numpy()})

    return rows.groupBy("instrument").applyInPandasWithState(update, "datetime timestamp, instrument string, value double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)
