"""The bookmark state over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.marks import CAP, Marks, _int

_OUT = "user_id long, n_marks int, newest string, last_book string"
_STATE = "marks array<struct<book:string,chapter:int,verse:int,ts:bigint>>, book string, chapter int, ts bigint"


def stream_marks(events: DataFrame, cap: int = CAP) -> DataFrame:
    """Of each micro-batch the users whose state changed: (user_id, n_marks, newest, last_book).

    Events of a user within a micro-batch are applied in order of ts and seq.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], None, None, None)
        own = Marks(cap, [tuple(m) for m in old[0]], None if old[1] is None else tuple(old[1:]))
        for e in pd.concat(list(batches)).sort_values(["ts", "seq"]).astype(object).itertuples(index=False):
            own.apply(e.action, (e.book, _int(e.chapter), _int(e.verse)), int(e.ts))
        listed = own.listed()
        state.update((listed, *(own.last_read or (None, None, None))))
        newest = ":".join(str(x) for x in listed[0][:3] if x is not None) if listed else None
        yield pd.DataFrame({"user_id": [key[0]], "n_marks": [len(listed)], "newest": [newest], "last_book": [own.last_read and own.last_read[0]]})

    return events.groupBy("user_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
