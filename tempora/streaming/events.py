"""Structured Streaming forms of bouts, rates and the as-of trial tag on an event log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_bouts(events: DataFrame, keys: Sequence[str], ts: str, gap: str, watermark: str) -> DataFrame:
    """Gap-based bouts by session window. Events exactly `gap` apart fall into two bouts."""
    return events.withWatermark(ts, watermark).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("bout_size"), F.min(ts).alias("bout_start"), F.max(ts).alias("bout_end")
    ).drop("w")


def stream_rates(events: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, watermark: str) -> DataFrame:
    """Counts per key in sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark(ts, watermark).groupBy(*keys, F.window(ts, size, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(*keys, F.col("w.start").alias("window_start"), "n")


#: Rows of a state entry or of a block of output.
ENTRY_ROWS = 10_000


class LastCue(StatefulProcessor):
    """Tags the rows of a session with the latest cue at or before them, second by second.

    What a session gets in a batch waits as one list entry of arrays, with one timer for its earliest second. Once the watermark
    has reached the end of that second, all rows whose second has ended are read, sorted and emitted at once; the others
    go back with the next timer. So a row is out exactly if the watermark has reached the end of its second, and a session
    costs a few state calls a batch, however many rows it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_cue", "trial bigint")
        self.open = handle.getListState("open", "event_ids array<bigint>, micros array<bigint>, cues array<boolean>")

    def _wake(self, micros: int) -> None:
        """A timer fires only once the watermark is beyond it, so it stands a millisecond before the second ends."""
        self.handle.registerTimer((micros // 1_000_000 + 1) * 1000 - 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for batch in rows:
            micros = batch["micros"].tolist()
            self.open.appendValue((batch["event_id"].tolist(), micros, batch["is_cue"].tolist()))
            first = min(micros) if first is None else min(first, *micros)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np
        import pandas as pd

        held = [(np.array(e, "int64"), np.array(m, "int64"), np.array(c, "bool")) for e, m, c in self.open.get()]
        if not held:
            return
        event_ids, micros, cues = (np.concatenate(x) for x in zip(*held))
        due = (micros // 1_000_000 + 1) * 1000 <= timerValues.getCurrentWatermarkInMs()
        if not due.any():
            self._wake(int(micros.min()))
            return
        if due.all():
            self.open.clear()
        else:
            later = np.flatnonzero(~due)
            parts = [later[i : i + ENTRY_ROWS] for i in range(0, len(later), ENTRY_ROWS)]
            self.open.put([(event_ids[i].tolist(), micros[i].tolist(), cues[i].tolist()) for i in parts])
            self._wake(int(micros[later].min()))
            event_ids, micros, cues = event_ids[due], micros[due], cues[due]
        order = np.lexsort((event_ids, ~cues, micros))
        trial = (self.last.get()[0] if self.last.exists() else -1) + np.cumsum(cues[order])
        if cues.any():
            self.last.update((int(trial[-1]),))
        for i in range(0, len(order), ENTRY_ROWS):
            part = order[i : i + ENTRY_ROWS]
            yield pd.DataFrame({"session": key[0], "event_id": event_ids[part], "trial": trial[i : i + ENTRY_ROWS]})

    def close(self) -> None:
        pass


def stream_asof_trial(events: DataFrame, ts: str, watermark: str) -> DataFrame:
    """(session, event_id, trial) with -1 before the first cue, emitted once the watermark has
    reached the end of the event's second. `events` has session, event_id, is_cue and `ts`; needs the RocksDB state
    store."""
    rows = events.withWatermark(ts, watermark).withColumn("micros", F.unix_micros(F.col(ts)))
    return rows.groupBy("session").transformWithStateInPandas(
        LastCue(), "session bigint, event_id bigint, trial bigint", "Append", "EventTime"
    )
