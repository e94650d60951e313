"""Extension beyond batch: run-length states of a live device log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_runs(log: DataFrame) -> DataFrame:
    """(worm, state, start, end) of each run once the next one begins.

    log: a stream of worm string, counter long, state string; a worm's rows must arrive in batches in order of counter,
    rows at or before the last counter seen are late and ignored. The state kept for a worm is its open run.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        out = []
        for f in frames:
            for counter, name in f.sort_values("counter")[["counter", "state"]].itertuples(index=False):
                if now is None:
                    now = [name, counter, counter]
                elif counter <= now[2]:
                    continue
                elif name == now[0]:
                    now[2] = counter
                else:
                    out.append((key[0], *now))
                    now = [name, counter, counter]
        if now is not None:
            state.update((now[0], int(now[1]), int(now[2])))
        yield pd.DataFrame(out, columns=["worm", "state", "start", "end"])

    return log.groupBy("worm").applyInPandasWithState(step, "worm string, state string, start long, end long", "state string, start long, end long", "append", GroupStateTimeout.NoTimeout)
