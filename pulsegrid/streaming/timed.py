"""Keyed stream operators whose state has parts, timers and an end; they can follow each other in one query.

Each is a ``StatefulProcessor`` for ``transformWithStateInPandas``. State that grows with a
window lies in a map by second of the video, so a batch rewrites the seconds that it touches
and drops those that have passed; the rest is not read into the new state. Every key holds
an event-time timer ``idle`` seconds after its latest row; when the watermark passes it, the
key's state is cleared, so a video that has ended costs nothing more. A row that comes later is
the first of a new run of its video.

Streams need a watermark on ``event_time``; the session needs the RocksDB state store, which
``with_state_store`` sets. Rows of a video must come in the order of their times across
batches; within a batch they are sorted. Rows not later than the last one seen are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pulsegrid.config import BlinkConfig, FrameConfig, RuleConfig, SequenceConfig

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that state variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Timed(StatefulProcessor):
    """A processor with one timer per key, ``idle`` seconds after the key's latest event time."""

    output: str

    def __init__(self, idle: float) -> None:
        self.idle_ms = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.variables = [self.timer, *self.declare(handle)]

    def declare(self, handle: StatefulProcessorHandle) -> list[Any]:
        raise NotImplementedError

    def step(self, key: tuple, frame: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows))
        if frame.empty:
            return
        self._set_timer(int(frame["event_time"].max().timestamp() * 1000) + self.idle_ms)
        if out := self.step(key, frame):
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.output.split(", ")])

    def _set_timer(self, at: int) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is None or at > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        for v in self.variables:
            v.clear()
        return iter(())

    def close(self) -> None:
        pass

    def over(self, rows: DataFrame, key: str = "video_id") -> DataFrame:
        return rows.groupBy(key).transformWithStateInPandas(self, self.output, "Append", "EventTime", eventTimeColumnName="event_time")


class States(Timed):
    """Frames (video_id, timestamp, p_closed, event_time) to smoothed signal, latch, closed duration and PERCLOS."""

    output = "video_id string, timestamp double, event_time timestamp, p_closed_smooth float, closed_state int, current_closed_duration float, perclos_10s float"

    def __init__(self, blink: BlinkConfig = BlinkConfig(), cfg: FrameConfig = FrameConfig(), idle: float = 60.0) -> None:
        super().__init__(idle)
        self.blink, self.cfg = blink, cfg

    def declare(self, handle: StatefulProcessorHandle) -> list[Any]:
        self.latch = handle.getValueState("latch", "closed int, since double, seen double")
        self.signals = handle.getListState("signals", "p float")
        self.seconds = handle.getMapState("seconds", "second long", "times array<double>, states array<int>")
        return [self.latch, self.signals, self.seconds]

    def step(self, key: tuple, frame: pd.DataFrame) -> list[tuple]:
        closed, since, seen = self.latch.get() if self.latch.exists() else (0, 0.0, -np.inf)
        p = [x[0] for x in self.signals.get()]
        held = sorted((s[0], list(v[0]), list(v[1])) for s, v in self.seconds.iterator())
        times, states = [t for _, ts, _ in held for t in ts], [x for _, _, xs in held for x in xs]
        first_new, out = len(times), []
        rows = frame[["timestamp", "p_closed", "event_time"]].sort_values("timestamp")
        for t, value, at in rows.itertuples(index=False):
            if t <= seen:
                continue
            seen = float(t)
            p = [*p, float(value)][-self.cfg.smooth_rows :]
            smooth = np.float32(min(1.0, max(0.0, sum(p) / len(p))))
            now = 1 if float(smooth) >= self.blink.start else 0 if float(smooth) <= self.blink.end else closed
            since = seen if now and not closed else since
            closed = now
            times.append(seen)
            states.append(closed)
            lo = int(np.searchsorted(times, seen - self.blink.window_sec))
            out.append((key[0], seen, at, smooth, closed, np.float32(seen - since if closed else 0.0), np.float32(sum(states[lo:]) / (len(states) - lo))))
        self.latch.update((closed, since, seen))
        self.signals.put([(x,) for x in p])
        self._keep(held, times, states, first_new, seen)
        return out

    def _keep(self, held: list, times: list[float], states: list[int], first_new: int, seen: float) -> None:
        """Seconds that have passed go; those of the batch's rows are written; the others stay as they lie."""
        oldest = int(np.floor(seen - self.blink.window_sec)) if times else 0
        for second, _, _ in held:
            if second < oldest:
                self.seconds.removeKey((second,))
        for second in sorted({int(np.floor(t)) for t in times[first_new:]}):
            if second >= oldest:
                own = [i for i, t in enumerate(times) if int(np.floor(t)) == second]
                self.seconds.updateValue((second,), ([times[i] for i in own], [states[i] for i in own]))


class Sequences(Timed):
    """Frames (video_id, timestamp, event_time, features) to sequences of ``length`` frames, one every ``stride``."""

    output = "video_id string, seq_idx long, start_time double, end_time double, event_time timestamp, x array<array<float>>"

    def __init__(self, features: tuple[str, ...], cfg: SequenceConfig = SequenceConfig(), idle: float = 60.0) -> None:
        super().__init__(idle)
        self.features, self.cfg = features, cfg

    def declare(self, handle: StatefulProcessorHandle) -> list[Any]:
        self.count = handle.getValueState("count", "seen long, last double")
        self.frames = handle.getMapState("frames", "place long", "t double, x array<float>")
        return [self.count, self.frames]

    def step(self, key: tuple, frame: pd.DataFrame) -> list[tuple]:
        seen, last = self.count.get() if self.count.exists() else (0, -np.inf)
        held = {k[0]: (v[0], list(v[1])) for k, v in self.frames.iterator()}
        old, out = set(held), []
        rows = frame.sort_values("timestamp")
        for t, at, x in zip(rows["timestamp"].astype(float), rows["event_time"], rows[list(self.features)].to_numpy(np.float32).tolist()):
            if t <= last:
                continue
            held[seen], last, seen = (t, x), t, seen + 1
            start = seen - self.cfg.length
            if start >= 0 and start % self.cfg.stride == 0:
                own = [held[i] for i in range(start, seen)]
                out.append((key[0], start // self.cfg.stride, own[0][0], t, at, [x for _, x in own]))
        self.count.update((seen, last))
        needed = range(max(0, seen - self.cfg.length + 1), seen)
        for place in old - set(needed):
            self.frames.removeKey((place,))
        for place in needed:
            if place not in old:
                self.frames.updateValue((place,), held[place])
        return out


class SmoothedPredictions(Timed):
    """Sequences (video_id, seq_idx, event_time, prob_0..2) to the mean of the last probabilities, the prediction and its changes.

    The first ``warmup`` sequences of a video give no row, but count in the means.
    """

    output = "video_id string, seq_idx long, event_time timestamp, smooth_prob_0 double, smooth_prob_1 double, smooth_prob_2 double, pred_label_id int, changed int"

    def __init__(self, cfg: RuleConfig = RuleConfig(), idle: float = 60.0) -> None:
        super().__init__(idle)
        self.cfg = cfg

    def declare(self, handle: StatefulProcessorHandle) -> list[Any]:
        self.place = handle.getValueState("place", "n long, last long, pred int")
        self.probs = handle.getListState("probs", "p0 double, p1 double, p2 double")
        return [self.place, self.probs]

    def step(self, key: tuple, frame: pd.DataFrame) -> list[tuple]:
        n, last, pred = self.place.get() if self.place.exists() else (0, -1, -1)
        probs, out = [tuple(p) for p in self.probs.get()], []
        for i, at, *p in frame[["seq_idx", "event_time", "prob_0", "prob_1", "prob_2"]].sort_values("seq_idx").itertuples(index=False):
            if i <= last:
                continue
            probs = [*probs, tuple(map(float, p))][-self.cfg.smooth_windows :]
            mean = [sum(x) / len(probs) for x in zip(*probs)]
            now, last = int(np.argmax(mean)), int(i)
            if n >= self.cfg.warmup:
                out.append((key[0], last, at, *mean, now, int(pred >= 0 and now != pred)))
                pred = now
            n += 1
        self.place.update((n, last, pred))
        self.probs.put(probs)
        return out
