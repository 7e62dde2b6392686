"""The decision log as a stream: standing decisions kept up to date by source.

An addition to the batch replay, for logs that arrive bit by bit.  State is each
source's stack of decisions that stand; undo pops it.  Decisions of one source
must arrive in order, as files of the log do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "source long, depth long, item long, action string"
STATE = "items array<long>, actions array<string>"


def standing(log: DataFrame) -> DataFrame:
    """For each source that a batch touches: its depth and the decision on top (null when none stands)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items, actions = (list(x) for x in state.get) if state.exists else ([], [])
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if row.action != "undo":
                items.append(int(row.item))
                actions.append(row.action)
            elif items:
                items.pop()
                actions.pop()
        state.update((items, actions))
        yield pd.DataFrame({"source": [key[0]], "depth": [len(items)], "item": pd.array([items[-1] if items else None], dtype="Int64"), "action": [actions[-1] if actions else None]})

    return log.groupBy("source").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")
