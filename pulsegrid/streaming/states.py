"""Streaming forms of smoothing, latch, closed duration and PERCLOS, of blinks and of sequences.

Row windows are not defined on streams, so a keyed state per video keeps what the trailing
windows need: the last few signals, the latch, and the states of the last seconds. Its size
is bounded by the window's seconds times the frame rate. Frames of a video must arrive in
the order of their times across batches; within a batch they are sorted. A frame that is
not later than the last one seen is left out, as is one sent twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.config import BlinkConfig, FrameConfig, SequenceConfig

OUTPUT = "video_id string, timestamp double, p_closed_smooth float, closed_state int, current_closed_duration float, perclos_10s float"
STATE = "p array<float>, closed int, since double, times array<double>, states array<int>"


def stream_states(frames: DataFrame, blink: BlinkConfig = BlinkConfig(), cfg: FrameConfig = FrameConfig()) -> DataFrame:
    """Frames (video_id, timestamp, p_closed without gaps) to their states; works on streams."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, closed, since, times, states = state.get if state.exists else ([], 0, 0.0, [], [])
        p, times, states = list(p), list(times), list(states)
        rows = []
        for t, value in pd.concat(list(batches))[["timestamp", "p_closed"]].sort_values("timestamp").itertuples(index=False):
            if times and t <= times[-1]:
                continue
            p = [*p, float(value)][-cfg.smooth_rows :]
            smooth = np.float32(min(1.0, max(0.0, sum(p) / len(p))))
            now = 1 if float(smooth) >= blink.start else 0 if float(smooth) <= blink.end else closed
            since = float(t) if now and not closed else since
            closed = now
            times.append(float(t))
            states.append(closed)
            first = next(i for i, x in enumerate(times) if x >= t - blink.window_sec)
            times, states = times[first:], states[first:]
            rows.append((key[0], t, smooth, closed, np.float32(t - since if closed else 0.0), np.float32(sum(states) / len(states))))
        state.update((p, closed, since, times, states))
        yield pd.DataFrame(rows, columns=["video_id", "timestamp", "p_closed_smooth", "closed_state", "current_closed_duration", "perclos_10s"])

    return frames.groupBy("video_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


BLINKS = "video_id string, timestamp double, avg_blink_duration_10s float, avg_blink_amplitude_10s float, avg_opening_velocity_10s float, blink_frequency_10s float, time_since_last_blink float"
BLINK_STATE = "opened array<double>, least array<double>, closed int, seen double, last double, events array<array<double>>"


def stream_blinks(states: DataFrame, cfg: BlinkConfig = BlinkConfig()) -> DataFrame:
    """Frames (video_id, timestamp, closed_state, ear_z) to the means, frequency and age of their blinks.

    The state holds the open closure's first and lowest frame, the end of the last blink,
    and the blinks that ended within the window. Order and repeats as above.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, least, closed, seen, last, events = state.get if state.exists else ([], [], 0, -np.inf, -np.inf, [])
        opened, least, events = list(opened), list(least), [list(e) for e in events]
        rows = []
        frame = pd.concat(list(batches))[["timestamp", "closed_state", "ear_z"]].sort_values("timestamp")
        for t, now, ear in zip(frame["timestamp"].astype(float), frame["closed_state"].astype(int), frame["ear_z"].astype(float)):
            if t <= seen:
                continue
            seen = t
            if now and not closed:
                opened, least = [t, ear], [t, ear]
            elif (now or closed) and ear < least[1]:
                least = [t, ear]
            if closed and not now:
                took, amplitude = t - opened[0], (opened[1] + ear) / 2 - least[1]
                if cfg.min_duration <= took <= cfg.max_duration and amplitude >= cfg.min_amplitude:
                    events.append([t, took, amplitude, (ear - least[1]) / max(t - least[0], 1e-6)])
                    last = t
            closed = now
            events = [e for e in events if e[0] >= t - cfg.window_sec]
            means = np.mean([e[1:] for e in events], axis=0) if events else np.zeros(3)
            rows.append((key[0], t, *means.astype(np.float32), len(events) / cfg.window_sec, min(t - last, cfg.cap_sec)))
        state.update((opened, least, closed, seen, last, events))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLINKS.split(", ")])

    return states.groupBy("video_id").applyInPandasWithState(step, BLINKS, BLINK_STATE, "append", GroupStateTimeout.NoTimeout)


SEQUENCES = "video_id string, seq_idx long, start_row long, start_time double, end_time double, x array<array<float>>"
SEQUENCE_STATE = "times array<double>, rows array<array<float>>, seen long"


def stream_sequences(rows: DataFrame, features: tuple[str, ...], cfg: SequenceConfig = SequenceConfig()) -> DataFrame:
    """Frames (video_id, timestamp, features) to sequences of ``length`` frames, one every ``stride`` frames.

    The state holds the last ``length`` frames and their count. A sequence appears with the
    frame that fills it; order and repeats as above.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, kept, seen = state.get if state.exists else ([], [], 0)
        times, kept = list(times), [list(r) for r in kept]
        out = []
        frame = pd.concat(list(batches)).sort_values("timestamp")
        for t, values in zip(frame["timestamp"].astype(float), frame[list(features)].to_numpy(np.float32).tolist()):
            if times and t <= times[-1]:
                continue
            times, kept, seen = [*times, t][-cfg.length :], [*kept, values][-cfg.length :], seen + 1
            start = seen - cfg.length
            if start >= 0 and start % cfg.stride == 0:
                out.append((key[0], start // cfg.stride, start, times[0], t, list(kept)))
        state.update((times, kept, seen))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCES.split(", ")])

    return rows.groupBy("video_id").applyInPandasWithState(step, SEQUENCES, SEQUENCE_STATE, "append", GroupStateTimeout.NoTimeout)
