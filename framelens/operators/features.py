"""Window feature tables and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelens.config import LABELS, WindowConfig
from framelens.functions.numeric import count_if, half_even, is_one, sample_std, share
from framelens.operators.clean import valid_flag
from framelens.operators.series import Series
from framelens.operators.windows import assign_valid_windows, attach_frames, count_windows_strict

RATIOS = {"face_detect_ratio": "face_detected", "pose_valid_ratio": "pose_valid",
          "ear_valid_ratio": "ear_valid", "ear_suspicious_ratio": "ear_suspicious"}


def quality_ratios(columns: list[str]) -> list[Column]:
    """Unrounded flag shares; a flag column the table lacks gives null."""
    return [(share(is_one(flag)) if flag in columns else F.lit(None).cast("double")).alias(name)
            for name, flag in RATIOS.items()]


def ear_stats() -> list[Column]:
    ear = F.col("avg_ear")
    return [F.avg(ear).alias("mean_ear"), sample_std(ear).alias("std_ear"),
            F.min(ear).alias("min_ear"), F.max(ear).alias("max_ear")]


def pose_stats() -> list[Column]:
    return [stat.alias(f"{name}_{axis}") for axis in ("yaw", "pitch", "roll") for name, stat in (
        ("mean_abs", F.avg(F.abs(F.col(axis)))), ("std", sample_std(F.col(axis))),
        ("max_abs", F.max(F.abs(F.col(axis)))))]


def closed_share(threshold: float, counted: Column | None = None) -> tuple[Column, Column]:
    """Closed-eye rows and counted rows; a null signal is not closed."""
    counted = F.lit(True) if counted is None else counted
    return count_if(counted & (F.col("avg_ear") < F.lit(threshold))), count_if(counted)


def usable_flag(cfg: WindowConfig = WindowConfig()) -> Column:
    return F.when(
        (F.col("face_detect_ratio") >= cfg.min_face_ratio) & (F.col("pose_valid_ratio") >= cfg.min_pose_ratio)
        & (F.col("ear_valid_ratio") >= cfg.min_ear_ratio), F.lit(1)).otherwise(F.lit(0))


def _finish(df: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Derived columns; the gate is taken from the ratios before they are rounded."""
    ratio = F.col("closed_eye_frames") / F.col("total_frames_perclos").cast("double")
    return (df.withColumn("is_usable", usable_flag(cfg))
            .withColumns({name: half_even(F.col(name), 4) for name in RATIOS})
            .withColumns({"perclos": half_even(ratio, 4), "perclos_percent": half_even(ratio * 100.0, 2)}))


def _aggregate(df: DataFrame, s: Series, valid: Column, cfg: WindowConfig, extra: list[str]) -> DataFrame:
    closed, total = closed_share(cfg.ear_threshold, valid)
    at = F.when(valid, F.col(s.order))
    return df.groupBy(*s.keys, *extra, "window_id").agg(
        F.min(at).cast("long").alias("window_start_frame"),
        F.max(at).cast("long").alias("window_end_frame"),
        F.min_by("time_sec", at).alias("window_start_time"),
        F.max_by("time_sec", at).alias("window_end_time"),
        closed.alias("closed_eye_frames"), total.alias("total_frames_perclos"),
        F.count(F.lit(1)).alias("frame_count_source"),
        *quality_ratios(df.columns), *ear_stats(), *pose_stats(),
    )


def window_features(frames: DataFrame, s: Series = Series(), cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Features of every window of ``cfg.size`` valid frames: one ordered pass, one aggregate."""
    placed = assign_valid_windows(frames, cfg.size, valid_flag("perclos"), s)
    return _finish(_aggregate(placed, s, F.col("valid"), cfg, []), cfg)


def features_from_bounds(frames: DataFrame, bounds: DataFrame, s: Series = Series(),
                         cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """The same table from stored window bounds, through the range join; audits recompute with it."""
    spans = bounds.select(*s.keys, "window_id", "start_frame", "end_frame")
    return _finish(_aggregate(attach_frames(frames, spans, s), s, valid_flag("perclos"), cfg, []), cfg)


def normal_window_features(frames: DataFrame, s: Series = Series(), cfg: WindowConfig = WindowConfig(),
                           extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Features of exact blocks of normal frames, PERCLOS over all rows, and the error rows."""
    blocks, errors = count_windows_strict(frames, cfg.size, s)
    return _finish(_aggregate(blocks, s, F.lit(True), cfg, list(extra)), cfg), errors


def with_identity(df: DataFrame) -> DataFrame:
    """Path columns of a window row."""
    return df.withColumns({
        "file_name": F.concat("file_stem", F.lit(".csv")),
        "source_file": F.concat_ws("/", "label", "modality", F.concat("file_stem", F.lit(".csv")))})


def summary_by(windows: DataFrame, keys: tuple[str, ...] = ("label", "modality"), digits: int | None = 4) -> DataFrame:
    means = {"mean_perclos": "perclos", "mean_ear": "mean_ear",
             "mean_abs_yaw": "mean_abs_yaw", "mean_abs_pitch": "mean_abs_pitch"}
    shown = (lambda c: c) if digits is None else (lambda c: half_even(c, digits))
    return windows.groupBy(*keys).agg(
        F.count("window_id").alias("window_count"),
        F.sum("is_usable").cast("long").alias("usable_window_count"),
        *[shown(F.avg(src)).alias(name) for name, src in means.items()])


def gaze_stream_summary(windows: DataFrame, keys: tuple[str, ...], digits: int | None = 4) -> DataFrame:
    means = {"mean_valid_ratio": "gaze_valid_ratio", "mean_idt_fixation_count": "idt_fixation_count",
             "mean_ivt_fixation_count": "ivt_fixation_count", "mean_rapid_shift_count": "rapid_shift_count"}
    shown = (lambda c: c) if digits is None else (lambda c: half_even(c, digits))
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.coalesce(F.sum("usable_window"), F.lit(0)).cast("long").alias("usable_window_count"),
        *[shown(F.avg(src)).alias(name) for name, src in means.items()])


def quality_summary(frames: DataFrame, keys: tuple[str, ...], ear_threshold: float = 0.21) -> DataFrame:
    """Whole-series quality; ``keys=()`` gives one row, zeros for an empty table."""
    valid = valid_flag("perclos")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    closed, total = closed_share(ear_threshold, valid)
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_frames"),
        zero(share(is_one("face_detected"))).alias("detected_face_ratio"),
        zero(share(is_one("pose_valid"))).alias("valid_pose_ratio"),
        zero(share(is_one("ear_valid"))).alias("valid_ear_ratio"),
        zero(share(is_one("ear_suspicious"))).alias("suspicious_ear_ratio"),
        total.alias("valid_frame_count"),
        zero(F.when(total > 0, closed / total.cast("double"))).alias("stream_perclos"))


def extraction_quality(frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Percentages of frames without a face, with a face but no pose, and with a suspicious eye signal."""
    base = F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")
    face = is_one("face_detected")
    return frames.groupBy(*keys).agg(
        (count_if(~face) * 100.0 / base).alias("pct_no_face"),
        (count_if(face & ~is_one("pose_valid")) * 100.0 / base).alias("pct_pose_invalid"),
        (count_if(is_one("ear_suspicious")) * 100.0 / base).alias("pct_ear_suspicious"))


def label_order(label: Column) -> Column:
    return F.array_position(F.lit(list(LABELS)), label)
