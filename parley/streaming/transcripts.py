"""The growing transcript of live conversations as keyed state.

State of a conversation, each part written only where it changes:

* a list of the utterance pairs said so far (as JSON texts): a new pair is
  appended, the earlier ones are not rewritten;
* a map of pairs that wait for a missing one before them;
* one value: the next number, how many wait, the latest event time;
* with an idle limit, one event-time timer.

An update reads the list once, since every output row is the transcript so far,
and joins texts: it costs its output plus the new pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.schemas import CALLER, VICTIM

TRANSCRIPT_OUT = "prefix_id string, conv_id string, prefix_no int, caller string, victim string, gap boolean"
ROWS_PER_YIELD = 64  # transcript rows handed over at once

# Keyed state with lists, maps and timers needs this state store.  With changes
# instead of snapshots at every batch, and one store instead of four for a join
# before it, a state partition takes less than half the disk.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


class Transcript(StatefulProcessor):
    """Appends a conversation's pairs in ``seq`` order and emits the whole
    transcript so far at every step.

    Pairs that arrive ahead of a missing ``seq`` wait until the gap closes.
    With an idle limit they wait no longer than that: then they are emitted in
    order, the first behind a gap marked ``gap``, and the conversation goes on
    behind them.  A pair that turns up after its place was passed is emitted at
    once, marked too.  No pair is dropped, and the state outlives the idle
    time, so a conversation that comes back continues its numbers.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "caller string, victim string")
        self.waiting = handle.getMapState("waiting", "seq long", "caller string, victim string")
        self.at = handle.getValueState("at", "next_seq long, n_waiting long, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        next_seq, n_waiting, last_ms = self.at.get() if self.at.exists() else (0, 0, 0)
        late, new = [], {}
        for frame in rows:
            for seq, caller, victim in zip(frame["seq"], frame["caller"], frame["victim"]):
                if int(seq) < next_seq:
                    late.append((int(seq), (caller, victim)))
                else:
                    new[int(seq)] = (caller, victim)
            if self.idle_ms is not None and len(frame):
                last_ms = max(last_ms, int(pd.to_datetime(frame["event_ts"]).max().value // 1_000_000))
        ready = [(seq, pair, True) for seq, pair in sorted(late, key=lambda x: x[0])]
        while True:
            if next_seq in new:
                ready.append((next_seq, new.pop(next_seq), False))
            elif n_waiting and self.waiting.containsKey((next_seq,)):
                ready.append((next_seq, tuple(self.waiting.getValue((next_seq,))), False))
                self.waiting.removeKey((next_seq,))
                n_waiting -= 1
            else:
                break
            next_seq += 1
        for seq, pair in new.items():
            n_waiting += not (n_waiting and self.waiting.containsKey((seq,)))
            self.waiting.updateValue((seq,), pair)
        self.at.update((next_seq, n_waiting, last_ms))
        if self.idle_ms is not None:
            self._wake(n_waiting, max(last_ms, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield from self._say(key[0], ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        next_seq, _, last_ms = self.at.get()
        ready = []
        for (seq,), pair in sorted(self.waiting.iterator()):
            ready.append((seq, tuple(pair), seq != next_seq))
            next_seq = seq + 1
        self.waiting.clear()
        self.at.update((next_seq, 0, last_ms))
        yield from self._say(key[0], ready)

    def _wake(self, n_waiting: int, at_ms: int) -> None:
        """One timer while pairs wait, none otherwise."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if n_waiting:
            self.handle.registerTimer(at_ms)

    def _say(self, conv_id, ready: list[tuple]) -> Iterator[pd.DataFrame]:
        if not ready:
            return
        before = list(self.said.get()) if self.said.exists() else []
        callers, victims = (",".join(p[i] for p in before) for i in (0, 1))
        self.said.appendList([pair for _, pair, _ in ready])
        lead = "," if before else ""
        rows = []
        for seq, (caller, victim), gap in ready:
            callers, victims, lead = f"{callers}{lead}{caller}", f"{victims}{lead}{victim}", ","
            name = None if conv_id is None else f"{conv_id}_{seq}"
            rows.append((name, conv_id, seq, f"[{callers}]", f"[{victims}]", gap))
            if len(rows) >= ROWS_PER_YIELD:
                yield pd.DataFrame(rows, columns=_COLUMNS)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)


_COLUMNS = [f.split()[0] for f in TRANSCRIPT_OUT.split(", ")]


def stream_running_transcript(pairs: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Growing transcript per conversation (X6), stream twin of the prefix
    expansion: every new pair re-emits both channels' lists so far.  The
    channel values travel as JSON texts, so any list type fits the state.

    ``idle_ms`` (needs a watermark on ``event_ts``) limits how long pairs wait
    for a missing one before them; by default they wait for it.  The session's
    state store is set to the one that keyed lists and maps need.
    """
    for name, value in STATE_CONF.items():
        pairs.sparkSession.conf.set(name, value)
    # Spark also starts the processor in a process of its own beside the driver,
    # which has no shipped package; it travels by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    text = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("null")).alias(c)
    packed = pairs.select("conv_id", "seq", "event_ts", text(CALLER), text(VICTIM))
    mode = "None" if idle_ms is None else "EventTime"
    return packed.groupBy("conv_id").transformWithStateInPandas(Transcript(idle_ms), TRANSCRIPT_OUT, "Append", mode)
