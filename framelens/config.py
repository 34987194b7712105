"""Thresholds, column lists and model defaults.

Everything in this module is a fixed value that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

# Class labels in report order, sensor modalities.
LABELS = ("normal", "drowsiness", "distraction")
MODALITIES = ("IR", "RGB")

# Identity of one series.
STREAM_KEYS = ("label", "modality", "file_stem")

# Frame table columns.
FRAME_COLUMNS = (
    "frame", "time_sec", "face_detected", "yaw", "pitch", "roll",
    "pose_valid", "left_ear", "right_ear", "avg_ear", "ear_valid", "ear_suspicious",
)
OPTIONAL_FRAME_COLUMNS = ("ear_suspicious",)
SIGNAL_COLUMNS = ("avg_ear", "yaw", "pitch", "roll", "left_ear", "right_ear")

# Gaze sample columns.
GAZE_COLUMNS = (
    "frame", "time_sec", "face_detected",
    "left_iris_center_x_px", "left_iris_center_y_px",
    "right_iris_center_x_px", "right_iris_center_y_px",
    "iris_center_x_px", "iris_center_y_px",
    "left_iris_x_norm", "left_iris_y_norm",
    "right_iris_x_norm", "right_iris_y_norm",
    "iris_x_norm", "iris_y_norm",
)
# Fixed value: ending of gaze file stems, which the series name leaves out.
GAZE_FILE_SUFFIX = "_pymovements_input"
GAZE_REQUIRED = ("frame", "time_sec", "face_detected", "iris_x_norm", "iris_y_norm")

# Columns whose first non-null row starts a usable recording.
FIRST_USABLE_WIDE = (
    "frame", "time_sec", "face_detected", "pose_valid", "ear_valid",
    "avg_ear", "yaw", "pitch", "roll",
)
FIRST_USABLE_NARROW = ("avg_ear", "yaw", "pitch")

# Window columns that an audit recomputes, in comparison order.
AUDIT_COLUMNS = (
    "window_start_frame", "window_end_frame", "window_start_time", "window_end_time",
    "closed_eye_frames", "total_frames_perclos", "frame_count_source",
    "perclos", "perclos_percent",
    "face_detect_ratio", "pose_valid_ratio", "ear_valid_ratio", "ear_suspicious_ratio",
    "mean_ear", "std_ear", "min_ear", "max_ear",
    "mean_abs_yaw", "std_yaw", "max_abs_yaw",
    "mean_abs_pitch", "std_pitch", "max_abs_pitch",
    "mean_abs_roll", "std_roll", "max_abs_roll",
    "is_usable",
)

# Model inputs.
BASELINE_FEATURES = (
    "perclos", "perclos_percent",
    "mean_ear", "std_ear", "min_ear", "max_ear",
    "mean_abs_yaw", "std_yaw", "max_abs_yaw",
    "mean_abs_pitch", "std_pitch", "max_abs_pitch",
    "mean_abs_roll", "std_roll", "max_abs_roll",
    "face_detect_ratio", "pose_valid_ratio", "ear_valid_ratio",
)
EVENT_KINDS = ("idt_fixation", "ivt_fixation", "rapid_shift")
GAZE_STAT_COLUMNS = (
    "mean_iris_x_norm", "std_iris_x_norm", "min_iris_x_norm", "max_iris_x_norm",
    "mean_iris_y_norm", "std_iris_y_norm", "min_iris_y_norm", "max_iris_y_norm",
    "gaze_dispersion_x", "gaze_dispersion_y", "gaze_dispersion_xy",
    "gaze_path_length", "mean_step_distance",
    "mean_velocity_norm", "std_velocity_norm", "max_velocity_norm",
)
EVENT_COLUMNS = tuple(
    f"{kind}_{part}" for kind in EVENT_KINDS
    for part in ("count", "mean_duration_ms", "max_duration_ms", "ratio")
)
GAZE_FEATURES = tuple(
    f"gaze_{c}" for c in ("gaze_valid_ratio", "usable_window") + GAZE_STAT_COLUMNS + EVENT_COLUMNS
)


@dataclass(frozen=True)
class WindowConfig:
    """Fixed values for frame windows: 90 frames are 3 s at 30 fps."""

    size: int = 90
    ear_threshold: float = 0.21
    min_face_ratio: float = 0.80
    min_pose_ratio: float = 0.80
    min_ear_ratio: float = 0.80


@dataclass(frozen=True)
class NormalRule:
    """Strict bounds of an attentive window."""

    perclos: float = 0.15
    mean_ear: float = 0.22
    std_ear: float = 0.03
    mean_abs_yaw: float = 15.0
    mean_abs_pitch: float = 10.0
    max_abs_yaw: float = 20.0
    max_abs_pitch: float = 15.0


@dataclass(frozen=True)
class GazeConfig:
    """Fixed values for gaze windows and event detection."""

    window_sec: float = 3.0
    step_sec: float = 3.0
    min_valid_ratio: float = 0.5
    min_valid_samples: int = 3
    min_duration_ms: float = 100.0
    dispersion: float = 1.0
    velocity: float = 20.0
    default_period: float = 1.0 / 30.0


# Pose limits (degrees, pixels) and suspicious-eye yaw.
POSE_LIMITS = {"pitch": 60.0, "yaw": 90.0, "roll": 50.0}
MAX_REPROJECTION_PX = 12.0
SUSPICIOUS_YAW = 35.0

# Scoring presets.
PRESETS = {
    "quick": {"model_key": "xgboost_baseline", "clip_seconds": 30},
    "full": {"model_key": "xgboost_gaze_high_confidence", "clip_seconds": None},
}

# The four training scenarios, in report order.
SCENARIOS = (
    ("baseline", "baseline", False),
    ("high_confidence", "baseline", True),
    ("gaze_baseline", "gaze", False),
    ("gaze_high_confidence", "gaze", True),
)
