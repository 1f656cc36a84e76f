"""Stateful streams whose order holds across micro-batches.

Rows wait in list state until the watermark has passed them, then count in the order of their event time,
of equal times by ``ord``. So the result is that of a sort over the whole stream, however rows are cut
into micro-batches, as long as none is later than the watermark allows; Spark drops those that are. A
timer of event time wakes a key when its next row is due. A key that has nothing waiting is forgotten
``idle`` after its last row, where that is asked for; it begins anew when it comes back.

Output mode is append: a row comes out once, when it is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of any size needs the store that keeps it on disk; queries started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Ordered(StatefulProcessor):
    """Lets each row of a key count once the watermark has passed it; ``count`` says what it does."""

    #: Columns that wait, besides the time in milliseconds; and those of the key's own state.
    WAITING, STATE, START = "at bigint, ord bigint, what string", "", ()

    def __init__(self, time: str, what: str, idle_ms: int | None = None) -> None:
        self.time, self.what, self.idle = time, what, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.kept = handle.getValueState("kept", self.STATE)
        self.seen = handle.getValueState("seen", "last bigint")

    def count(self, key: tuple, state: tuple, at: int, order: int, what: str) -> tuple[tuple, list[tuple]]:
        """The state after a row, and the rows that come out."""
        raise NotImplementedError

    def columns(self) -> list[str]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the state is a message to the JVM, for every key of every batch: none without need
        fresh = []
        for pdf in rows:
            at = pdf[self.time].astype("datetime64[us]").astype("int64") // 1000
            fresh += list(zip(at.tolist(), pdf["ord"].tolist(), pdf[self.what].tolist(), strict=True))
        if fresh:
            self.waiting.appendList(fresh)
            if self.idle is not None:
                seen = self.seen.get()
                self.seen.update((max(seen[0] if seen else 0, *(a for a, *_ in fresh)),))
            self.handle.registerTimer(min(a for a, *_ in fresh) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due, rest = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        out = []
        if due:
            kept = self.kept.get()
            state = tuple(kept) if kept else self.START
            for at, order, what in due:
                state, made = self.count(key, state, at, order, what)
                out += made
            self.kept.update(state)
        if rest:
            if due:
                self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] + 1)
        else:
            if due:
                self.waiting.clear()
            if self.idle is not None and (seen := self.seen.get()):
                if seen[0] + self.idle < now:
                    self.kept.clear()
                    self.seen.clear()
                else:
                    self.handle.registerTimer(seen[0] + self.idle + 1)
        return iter([pd.DataFrame(out, columns=self.columns())] if out else ())

    def close(self) -> None:
        pass


class Lifecycle(Ordered):
    """Attempts, rejects and status of a card after each of its events."""

    STATE, START = "attempts int, rejects int, status string", (0, 0, "active")

    def __init__(self, time: str, max_rejects: int, idle_ms: int | None) -> None:
        super().__init__(time, "outcome", idle_ms)
        self.max_rejects = max_rejects

    def columns(self) -> list[str]:
        return ["evidence_id", "ord", "attempts", "rejects", "status"]

    def count(self, key: tuple, state: tuple, at: int, order: int, what: str) -> tuple[tuple, list[tuple]]:
        attempts, rejects, status = state
        attempts += what in ("attempt", "reject", "accept")
        if what == "reject":
            rejects += 1
            status = "stale" if rejects >= self.max_rejects else status
        elif what == "accept":
            status = "archived"
        elif what == "reactivate":
            rejects, status = 0, "active"
        state = (attempts, rejects, status)
        return state, [(key[0], order, *state)]


class CountWindows(Ordered):
    """A window whenever ``size`` cards of a pool have come; fewer than ``size`` ids are kept."""

    STATE, START = "made int, ids array<string>", (0, [])

    def __init__(self, time: str, size: int, idle_ms: int | None) -> None:
        super().__init__(time, "evidence_id", idle_ms)
        self.size = size

    def columns(self) -> list[str]:
        return ["pool", "window", "evidence_ids"]

    def count(self, key: tuple, state: tuple, at: int, order: int, what: str) -> tuple[tuple, list[tuple]]:
        made, ids = state[0], [*state[1], what]
        if len(ids) < self.size:
            return (made, ids), []
        return (made + 1, []), [(key[0], made, ids)]


def timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """Rows under a watermark; a time without zone is one of the session's."""
    return rows.withColumns({"ord": rows["ord"].cast("long"), time: rows[time].cast("timestamp")}).withWatermark(time, late)


def lifecycle(events: DataFrame, time: str, late: str = "10 minutes", max_rejects: int = 2, idle_ms: int | None = None) -> DataFrame:
    """(evidence_id, ord, attempts, rejects, status): the card after each event, in the order of ``time`` and ``ord``.

    Events have evidence_id, ord, outcome and the time. A null card is a card of its own; an outcome
    that isn't known counts as none. Events that the watermark has not passed wait.
    """
    rows = timed(events, time, late)
    schema = "evidence_id string, ord bigint, attempts int, rejects int, status string"
    return rows.groupBy("evidence_id").transformWithStateInPandas(Lifecycle(time, max_rejects, idle_ms), schema, "append", "eventTime")


def count_windows(cards: DataFrame, pool: str, time: str, size: int, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """(pool, window, evidence_ids): a window for each ``size`` cards of a pool, in the order of ``time`` and ``ord``."""
    rows = timed(cards, time, late)
    return rows.groupBy(pool).transformWithStateInPandas(CountWindows(time, size, idle_ms), "pool string, window int, evidence_ids array<string>", "append", "eventTime")


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a folder once, whatever fails and is started again."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
