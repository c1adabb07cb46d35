"""Bookmarks: a small keyed state per user, folded from events.

Event actions: ``add``, ``remove``, ``toggle``, ``read`` (last place read) and ``clear``. A mark is named by (book, chapter, verse);
no verse equals only no verse. The newest mark comes first; beyond the cap the oldest are gone for good.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 200
MARKS = "array<struct<book:string,chapter:int,verse:int,ts:bigint>>"
STATE = f"user_id long, last_read struct<book:string,chapter:int,ts:bigint>, marks {MARKS}"
EVENT = ["user_id", "ts", "seq", "action", "book", "chapter", "verse"]


def same_mark(a: Column, b: Column) -> Column:
    return a["book"].eqNullSafe(b["book"]) & a["chapter"].eqNullSafe(b["chapter"]) & a["verse"].eqNullSafe(b["verse"])


class Marks:
    """The state of one user."""

    def __init__(self, cap: int = CAP, marks: Iterable[tuple] = (), last_read: tuple | None = None):
        self.cap, self.last_read = cap, last_read
        self.marks: dict[tuple, int] = {}  # oldest first; a key is (book, chapter, verse)
        for book, chapter, verse, ts in reversed(list(marks)):
            self.marks[book, chapter, verse] = ts

    def apply(self, action: str, key: tuple, ts: int) -> None:
        if action == "toggle":
            action = "remove" if key in self.marks else "add"
        if action == "add":
            self.marks.pop(key, None)
            self.marks[key] = ts
            while len(self.marks) > self.cap:
                del self.marks[next(iter(self.marks))]
        elif action == "remove":
            self.marks.pop(key, None)
        elif action == "read":
            self.last_read = (key[0], key[1], ts)
        elif action == "clear":
            self.marks.clear()
            self.last_read = None

    def listed(self) -> list[tuple]:
        return [(*key, ts) for key, ts in reversed(self.marks.items())]


def _int(x: object) -> int | None:
    return None if x is None or x != x or x is pd.NA else int(x)


def fold_marks(events: DataFrame, cap: int = CAP) -> DataFrame:
    """State of each user after all events (user_id, ts: epoch ms, seq, action, book, chapter, verse), in order of ts and seq.

    Events stream through the tasks in order; a task holds one user's state of at most ``cap`` marks, however many events there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None

        def row() -> pd.DataFrame:
            read = state.last_read and dict(zip(("book", "chapter", "ts"), state.last_read, strict=True))
            return pd.DataFrame({"user_id": [user], "last_read": [read], "marks": [[dict(zip(("book", "chapter", "verse", "ts"), m, strict=True)) for m in state.listed()]]})

        for batch in batches:
            for e in batch.astype(object).itertuples(index=False):
                if state is None or e.user_id != user:
                    if state is not None:
                        yield row()
                    user, state = e.user_id, Marks(cap)
                state.apply(e.action, (e.book, _int(e.chapter), _int(e.verse)), int(e.ts))
        if state is not None:
            yield row()

    order = ["user_id", "ts", "seq"]
    return events.where("user_id IS NOT NULL").select(*EVENT).repartition("user_id").sortWithinPartitions(*order).mapInPandas(run, STATE)


def last_read(events: DataFrame) -> DataFrame:
    """(user_id, last): the latest ``read`` of each user."""
    place = F.struct("book", "chapter", F.col("ts"))
    return events.where("action = 'read'").groupBy("user_id").agg(F.max_by(place, F.struct("ts", "seq")).alias("last"))


def marked_verses(state: DataFrame, book: str, chapter: int) -> DataFrame:
    """(user_id, verses) marked in a chapter, in order."""
    return state.select("user_id", F.array_sort(F.transform(F.filter("marks", lambda m: (m["book"] == book) & (m["chapter"] == chapter) & m["verse"].isNotNull()), lambda m: m["verse"])).alias("verses"))


def export_marks(state: DataFrame, exported_at: Column | None = None) -> DataFrame:
    """(user_id, json) with the fields exportedAt, lastRead and bookmarks."""
    at = F.date_format(F.current_timestamp() if exported_at is None else exported_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return state.select("user_id", F.to_json(F.struct(at.alias("exportedAt"), F.col("last_read").alias("lastRead"), F.col("marks").alias("bookmarks")), {"ignoreNullFields": "false"}).alias("json"))


def import_marks(state: DataFrame, files: DataFrame) -> DataFrame:
    """The state with what ``files`` (user_id, json) hold in place of the old; absent or unreadable parts change nothing, and the cap doesn't apply."""
    kind = f"lastRead struct<book:string,chapter:int,ts:bigint>, bookmarks {MARKS}"
    read = files.select("user_id", F.from_json("json", kind, {"mode": "PERMISSIVE"}).alias("i"))
    both = state.join(read, "user_id", "full_outer")
    return both.select("user_id", F.coalesce("i.lastRead", "last_read").alias("last_read"), F.coalesce("i.bookmarks", "marks", F.array().cast(MARKS)).alias("marks"))


def kept_value(stored: Column, kind: str) -> Column:
    """What a key of the store holds, of the given kind; null where there is nothing or it can't be read."""
    return F.from_json(stored, kind, {"mode": "PERMISSIVE"})


def keep_value(store: DataFrame, changes: DataFrame, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """The store (key, value) after ``changes`` (key, value, seq): the last value of each key counts, and one that is null, as what can't be written, changes nothing."""
    new = changes.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias("__new"))
    return store.join(new, key, "full_outer").select(key, F.coalesce("__new", value).alias(value))
