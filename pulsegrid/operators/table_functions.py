"""Per-video table functions: a video's rows pass one by one, in order, and only the open closure is held."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import BlinkConfig

_PLACES = [f"{a}_{c}" for c in ("idx", "frame", "time") for a in ("start", "end", "min")]
COLUMNS = (
    "video_id string, " + ", ".join(f"{p} {'double' if p.endswith('time') else 'long'}" for p in _PLACES)
    + ", duration_sec double, duration long, amplitude double, opening_velocity double, p_closed_max double, ear_z_start double, ear_z_min double, ear_z_end double, blink_id long, frequency double"
)


class BlinkEvents:
    """Rows with video_id, processed_idx, frame_idx, timestamp, ear_z and p_closed_smooth to accepted blinks.

    A closure opens at the start threshold, not before the least pause after the last accepted
    one has passed, and closes at the end threshold. Called once per partition (video).
    """

    def __init__(self) -> None:
        self.cfg = BlinkConfig()
        self.start: tuple | None = None
        self.low: tuple | None = None
        self.top, self.last, self.n = 0.0, -float("inf"), 0

    def eval(self, row: Row) -> Iterator[tuple]:
        p, ear = float(row["p_closed_smooth"]), float(row["ear_z"])
        at = (row["processed_idx"], row["frame_idx"], float(row["timestamp"]), ear)
        if self.start is None:
            if p >= self.cfg.start and at[2] - self.last >= self.cfg.min_gap:
                self.start, self.low, self.top = at, at, p
            return
        self.top = max(self.top, p)
        if ear < self.low[3]:
            self.low = at
        if p <= self.cfg.end:
            yield from self._closed(row["video_id"], at)
            self.start = None

    def _closed(self, video: str, end: tuple) -> Iterator[tuple]:
        s, m = self.start, self.low
        took, amplitude = end[2] - s[2], (s[3] + end[3]) / 2 - m[3]
        if not self.cfg.min_duration <= took <= self.cfg.max_duration or not amplitude >= self.cfg.min_amplitude:
            return
        self.last, self.n = end[2], self.n + 1
        opening = (end[3] - m[3]) / max(end[2] - m[2], 1e-6)
        places = [p[i] for i in range(3) for p in (s, end, m)]
        yield (video, *places, took, end[1] - s[1] + 1, amplitude, opening, self.top, s[3], m[3], end[3], self.n - 1, self.n / max(end[2], 1e-6))


def register(spark: SparkSession) -> None:
    """Makes ``blink_events(TABLE(...) PARTITION BY video_id ORDER BY timestamp)`` known to SQL."""
    spark.udtf.register("blink_events", F.udtf(BlinkEvents, returnType=COLUMNS))


def blink_events(rows: DataFrame) -> DataFrame:
    """``blinks.blink_events_with_gap`` under the default settings, as a table function.

    Rows without a signal or an eye value are passed over.
    """
    register(rows.sparkSession)
    used = rows.where("p_closed_smooth IS NOT NULL AND ear_z IS NOT NULL").select("video_id", "processed_idx", "frame_idx", "timestamp", "ear_z", "p_closed_smooth")
    return rows.sparkSession.sql("SELECT e.* FROM blink_events(TABLE(SELECT * FROM {rows}) PARTITION BY video_id ORDER BY timestamp) AS e", rows=used)
