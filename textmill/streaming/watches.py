"""What a watcher of each key is told: changes of its state, pings while nothing changes, and the end."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Silence after which a ping is sent.
PING_MS = 15_000
NOTHING = (None, None, False, "[]")
TOLD = "key long, at long, event string, state string"
#: Keyed state with timers needs this store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class Watch(StatefulProcessor):
    """Rows wait until the watermark has passed them, so what is told doesn't depend on the batches they come in.

    State of a key: what was sent last and when, and the rows that wait (as JSON, one value: each call of the store costs as much as many rows); nothing of the
    past. Once a key has ended its rows are left out. A timer that runs out tells all that is due, so a key needs one for the earliest of its rows and its next ping
    only, however many rows wait.
    """

    def __init__(self, ping_ms: int):
        self.ping = ping_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string, at long, ended boolean, waiting string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, last, ended, waiting = self.kept.get() or NOTHING
        if not ended:
            new = [tuple(r)[-4:] for r in rows]
            self.kept.update((state, last, ended, json.dumps(json.loads(waiting) + new)))
            self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        state, last, ended, waiting = self.kept.get() or NOTHING
        rows = sorted(json.loads(waiting), key=lambda r: r[:2])
        told = []

        def pings(until: int) -> None:
            nonlocal last
            while last is not None and last + self.ping <= until:
                last += self.ping
                told.append((last, "ping", None))

        for at, _, new, terminal in rows:
            if at > upto or ended:
                break
            pings(at - 1)
            if last is None or new != state:
                state, last = new, at
                told.append((at, "progress", state))
            pings(at)
            if terminal:
                told.append((at, "end", state))
                ended = True
        left = [] if ended else [r for r in rows if r[0] > upto]
        if not ended:
            pings(upto)
            due = [r[0] for r in left[:1]] + ([] if last is None else [last + self.ping])
            if due:
                self.handle.registerTimer(min(due))
        if told or len(left) < len(rows):
            self.kept.update((state, last, ended, json.dumps(left)))
        return iter([Row(key=key[0], at=at, event=event, state=s) for at, event, s in told])

    def close(self) -> None:
        pass


def watched(events: DataFrame, key: str, time: str, order: str, state: Column, terminal: Column, delay: str, ping_ms: int = PING_MS) -> DataFrame:
    """A stream of key, at (milliseconds), event (progress, ping or end), state. events: a stream; key and order are longs, time a timestamp; rows that come later
    than `delay` are left out."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(time).alias("time"), F.unix_millis(time).alias("at"), F.col(order).cast("long").alias("n"), state.cast("string").alias("state"), terminal.alias("terminal"))
    return rows.withWatermark("time", delay).groupBy("key").transformWithState(Watch(ping_ms), TOLD, "append", "EventTime")
