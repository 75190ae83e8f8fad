"""Structured Streaming: a specification over a stream of keyed events.

Events of a key wait in the state until the watermark has passed their time; then the key's ticks are
stepped in order of time, timers between them. So the result is the batch result up to the watermark,
however events were spread over batches. Rows that come later than the watermark allows are dropped by
Spark; two events of one stream at the same time are an error. A query that starts again from its checkpoint goes on where it was.

Spark takes milliseconds for each state that it hands over, whatever the state holds; ``groups`` lets keys share states.

The state of a key stays for ever, unless ``expire`` says for how long a key may be silent: then it is forgotten, and a later
event of the key begins a new timeline at its own tick 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline import find_package
from tideline.functions import types as t
from tideline.functions.expr import Fault
from tideline.operators import graph as g
from tideline.operators.stepper import Stepper
from tideline.plans.spec import Spec

_TIME = "_event_time"
_GROUP = "_group"
_NO_KEY = -1  # the group of the key null


class _Keyed:
    """Events and operator state of the keys of one state; called by Spark with their new rows or at a timeout."""

    def __init__(self, spec: Spec, key: str, millis: int, expire: int | None, grouped: bool = False) -> None:
        self.stepper = Stepper(spec.outputs.values())
        self.ids = {n: g.resolve(s).id for n, s in spec.outputs.items()}
        self.inputs = {n: (s.id, s.type) for n, s in spec.inputs.items()}
        self.key, self.millis, self.expire, self.grouped = key, millis, expire, grouped

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st = self.stepper
        kept: dict[Any, tuple[tuple, dict[int, dict[int, Any]]]] = pickle.loads(state.get[0]) if state.exists else {}
        if isinstance(kept, tuple):  # a checkpoint's state from when each key had its own
            kept = {key[0]: kept}
        if not state.hasTimedOut:
            for frame in frames:
                self._take(kept, frame, key[0])
        mark = state.getCurrentWatermarkMs()
        rows: list[tuple] = []
        wake: list[int] = []
        for own, (snapshot, waiting) in list(kept.items()):
            due = sorted(ts for ts in waiting if ts * self.millis <= mark)
            if due:
                st.restore(snapshot)
                for ts in due:
                    for at, values in st.due(ts):
                        self._add(rows, own, at, values)
                    self._add(rows, own, ts, st.tick(ts, waiting.pop(ts)))
                snapshot = st.snapshot()
                kept[own] = (snapshot, waiting)
            forgotten = None if self.expire is None else snapshot[0] * self.millis + self.expire
            if waiting:
                wake.append(min(waiting) * self.millis)
            elif forgotten is not None and forgotten <= mark:
                del kept[own]
            elif forgotten is not None:
                wake.append(forgotten)
        if not kept:
            state.remove()
        else:
            state.update((pickle.dumps(kept),))
            if wake:
                state.setTimeoutTimestamp(max(min(wake), mark + 1))
        yield pd.DataFrame(rows, columns=[self.key, "ts", "stream", "value"])

    def _take(self, kept: dict[Any, tuple], frame: pd.DataFrame, group: Any) -> None:
        """New rows wait with their keys."""
        keys = frame[self.key].tolist() if self.grouped and group != _NO_KEY else [None if self.grouped else group] * len(frame)
        ticks = []
        for own, ts in zip(keys, frame["ts"].tolist(), strict=True):
            if own not in kept:
                self.stepper.reset()
                kept[own] = (self.stepper.snapshot(), {})
            ticks.append(kept[own][1].setdefault(int(ts), {}))
        for n, (i, kind) in self.inputs.items():
            for r, x in enumerate(frame[n].tolist()):
                if x is None or isinstance(x, float) and x != x or x is pd.NA:
                    continue
                if i in ticks[r]:
                    raise ValueError(f"two events of {n} at {frame['ts'].iloc[r]}")
                ticks[r][i] = t.decode(x, kind)

    def _add(self, rows: list[tuple], key: Any, ts: int, values: dict[int, Any]) -> None:
        for n, i in self.ids.items():
            if i in values:
                if isinstance(values[i], Fault):
                    raise ValueError(f"{n}: {values[i]} (at {ts})")
                rows.append((key, ts, n, t.show(values[i])))


def evaluate(stream: DataFrame, spec: Spec, key: str, delay: str = "0 seconds", millis: int = 1, expire: int | None = None, groups: int | None = None) -> DataFrame:
    """Output events (key, ts, stream, value as text) of a streaming DataFrame with ``key``, ``ts`` and a nullable column for each input.

    ``millis``: the length of a time unit in milliseconds; ``delay``: how late events may come; ``expire``: after how many
    milliseconds of event time without events a key's state goes. ``groups``: keys (integers or strings) share this many states instead of one each; results are
    the same, but an event at the very watermark may come a batch earlier. A batch writes each state that it touches as a whole, so that is for batches with events of most keys. A checkpoint keeps its number.
    """
    find_package(stream.sparkSession)
    timed = stream.withColumn(_TIME, F.timestamp_millis(F.col("ts") * millis)).withWatermark(_TIME, delay)
    kind = dict(stream.dtypes)[key]
    if groups is not None:
        if kind not in ("tinyint", "smallint", "int", "bigint", "string"):
            raise ValueError(f"keys that share states must be integers or strings, not {kind}")
        timed = timed.withColumn(_GROUP, F.when(F.col(key).isNull(), _NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(groups))).cast("long"))
    by = timed.groupBy(key if groups is None else _GROUP)
    return by.applyInPandasWithState(_Keyed(spec, key, millis, expire, groups is not None), f"{key} {kind}, ts long, stream string, value string", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
