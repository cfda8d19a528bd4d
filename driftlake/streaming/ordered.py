"""Keyed state that handles rows in event-time order, and acts when time passes without a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class OrderedProcessor(StatefulProcessor):
    """Buffers (second, number) per key until the watermark has passed them, so late rows within it fall into place.

    ``advance`` is called with all buffered pairs and the watermark in seconds; it returns output rows, the pairs that
    stay, and the next second at which it has to be called even if no row arrives.
    """

    columns: list[str]

    def __init__(self, key_names: list[str], time: str, value: str | None):
        self.key_names, self.time, self.value = key_names, time, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint", "n bigint")
        self.own = handle.getValueState("own", "a bigint, b bigint, c bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            seconds = frame[self.time].to_numpy().astype("datetime64[s]").astype("int64")
            values = frame[self.value].astype("int64") if self.value else pd.Series(1, index=frame.index)
            for t, n in values.groupby(seconds).sum().items():
                known = self.waiting.getValue((int(t),))[0] if self.waiting.containsKey((int(t),)) else 0
                self.waiting.updateValue((int(t),), (known + int(n),))
        yield self._run(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._run(key, timerValues)

    def _run(self, key, timerValues) -> pd.DataFrame:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        pairs = {k[0]: v[0] for k, v in self.waiting.iterator()}
        state = self.own.get() if self.own.exists() else None
        out, gone, state, wake = self.advance(pairs, state, now)
        for t in gone:
            self.waiting.removeKey((t,))
        if state is None:
            self.own.clear()
        else:
            self.own.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wake is not None:
            self.handle.registerTimer(int(wake * 1000) + 1)
        times = [c for c in self.columns if c.endswith("_at")]
        frame = pd.DataFrame([(*key, *row) for row in out], columns=[*self.key_names, *self.columns])
        for c in times:
            frame[c] = pd.to_datetime(frame[c], unit="s")
        return frame

    def advance(self, pairs: dict[int, int], state: tuple | None, now: float):
        raise NotImplementedError

    def close(self) -> None:
        pass
