"""Settings of the plans, passed explicitly; the defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Raw columns that are calibrated and the names of their z scores.
RAW_COLUMNS = ("mean_ear", "mar", "pitch", "yaw", "roll")
Z_COLUMNS = ("ear_z", "mar_z", "pitch_z", "yaw_z", "roll_z")
#: The order of a frame's features.
FEATURES = (
    "ear_z", "p_closed", "mar_z", "pitch_z", "yaw_z", "roll_z", "current_closed_duration", "perclos_10s",
    "avg_blink_duration_10s", "avg_blink_amplitude_10s", "avg_opening_velocity_10s", "blink_frequency_10s",
    "time_since_last_blink",
)
#: Score, label, label id and the data set's own name.
LABELS = (("0", "normal", 0, "Alert"), ("5", "drowsy", 1, "Low Vigilant"), ("10", "sleepy", 2, "Drowsy"))


# The defaults of the settings below.


@dataclass(frozen=True)
class FrameConfig:
    target_fps: int = 15
    calibration_score: str = "0"
    calibration_ratio: float = 1 / 3
    calibration_part: str = "first"
    min_calibration_frames: int = 30
    interpolate_limit: int = 5
    smooth_rows: int = 5


@dataclass(frozen=True)
class BlinkConfig:
    start: float = 0.70
    end: float = 0.30
    min_duration: float = 0.05
    max_duration: float = 2.0
    min_amplitude: float = 0.10
    min_gap: float = 0.05
    window_sec: float = 10.0
    cap_sec: float = 10.0

    def __post_init__(self) -> None:
        if self.start <= self.end:
            raise ValueError("a latch needs a start threshold above its end threshold")

    def without_pause(self) -> None:
        """Raises where the least pause between blinks may bind: the default is shorter than a frame at 15 a second."""
        if self.min_gap > 1 / 15:
            raise ValueError(f"a pause of {self.min_gap} s needs blink_events_with_gap")


@dataclass(frozen=True)
class SequenceConfig:
    length: int = 150
    stride: int = 75
    min_face_rate: float = 0.50
    head_down: str = "abs"
    caps: dict = field(
        default_factory=lambda: {"perclos": 0.60, "closed": 2.0, "p": 0.80, "yawn": 3.0, "head": 3.0, "head_down": 3.0, "blink": 0.60}
    )

    def __post_init__(self) -> None:
        if self.head_down not in ("abs", "positive", "negative"):
            raise ValueError(f"no such direction: {self.head_down}")


@dataclass(frozen=True)
class RuleConfig:
    use_rule: bool = True
    mode: str = "boost"
    use_yawn: bool = False
    use_head: bool = True
    closed_sec: float = 2.0
    max_closed_sec: float = 3.0
    perclos: float = 0.70
    p_closed: float = 0.50
    p_closed_perclos: float = 0.40
    yawn_z: float = 2.5
    yawn_p_closed: float = 0.60
    head_z: float = 2.8
    min_sleepy: float = 0.65
    normal_guard: float = 0.95
    smooth_windows: int = 3
    warmup: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("boost", "force"):
            raise ValueError(f"no such mode: {self.mode}")


#: The fixtures' videos have some 66 rows: shorter sequences, fewer calibration frames, and
#: a rolling window that slides within the video.
FIXTURE_FRAMES = FrameConfig(min_calibration_frames=8)
FIXTURE_SEQUENCES = SequenceConfig(length=30, stride=15)
SHORT_BLINKS = BlinkConfig(window_sec=2.5)
