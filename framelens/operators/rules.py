"""Rule labelling, confidence filters and training-row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelens.config import BASELINE_FEATURES, GAZE_FEATURES, NormalRule
from framelens.functions.numeric import all_of, half_even
from framelens.operators.series import Series, scan
from framelens.operators.windows import sliding_count_windows

RULE_STATS = ("perclos", "mean_ear", "std_ear", "mean_abs_yaw", "mean_abs_pitch", "max_abs_yaw", "max_abs_pitch")
BOUNDS = ("window_start_frame", "window_end_frame", "window_start_time", "window_end_time")


def normal_rule(cfg: NormalRule = NormalRule(), prefix: str = "") -> Column:
    """Attentive window: every bound is strict, and an unknown value fails it."""
    c = lambda name: F.col(prefix + name)
    return all_of(
        c("perclos") < cfg.perclos, c("mean_ear") > cfg.mean_ear, c("std_ear") < cfg.std_ear,
        c("mean_abs_yaw") < cfg.mean_abs_yaw, c("mean_abs_pitch") < cfg.mean_abs_pitch,
        c("max_abs_yaw") < cfg.max_abs_yaw, c("max_abs_pitch") < cfg.max_abs_pitch)


def normal_window_table(placed: DataFrame, s: Series, cfg: NormalRule = NormalRule(),
                        ear_threshold: float = 0.21) -> DataFrame:
    """Windows that satisfy the normal rule, numbered 1.. per series in window order."""
    closed = F.sum(F.when(F.col("avg_ear") < F.lit(ear_threshold), 1).otherwise(0))
    stats = placed.groupBy(*s.keys, "window_index").agg(
        F.min(s.order).cast("long").alias("window_start_frame"),
        F.max(s.order).cast("long").alias("window_end_frame"),
        F.min_by("time_sec", s.order).alias("window_start_time"),
        F.max_by("time_sec", s.order).alias("window_end_time"),
        (closed / F.count(F.lit(1)).cast("double")).alias("perclos"),
        F.avg("avg_ear").alias("mean_ear"), F.stddev_samp("avg_ear").alias("std_ear"),
        F.avg(F.abs("yaw")).alias("mean_abs_yaw"), F.avg(F.abs("pitch")).alias("mean_abs_pitch"),
        F.max(F.abs("yaw")).alias("max_abs_yaw"), F.max(F.abs("pitch")).alias("max_abs_pitch"))
    normal = stats.filter(normal_rule(cfg))
    return scan(normal, s.ordered("window_index"), running={"window_id": F.lit(1)})


def _joined(values: Column) -> Column:
    return F.array_join(F.array_distinct(values), "; ")


def _short(value: Column) -> Column:
    """Four decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", "")


def extract_normal_frames(cleaned: DataFrame, size: int, step: int, s: Series = Series(),
                          cfg: NormalRule = NormalRule()) -> DataFrame:
    """Cleaned rows inside at least one normal window, with the statistics of their windows as text.

    A row lies in at most ``ceil(size/step)`` windows, which bounds what is gathered per row.
    """
    placed = sliding_count_windows(cleaned, size, step, s)
    windows = normal_window_table(placed, s, cfg)
    member = placed.join(windows, [*s.keys, "window_index"])
    numbers = ("window_id", "window_start_frame", "window_end_frame")
    rounded = {n: half_even(F.col(n), 4) for n in RULE_STATS}
    info = F.struct("window_index", *numbers, "window_start_time", "window_end_time",
                    *[rounded[n].alias(n) for n in RULE_STATS])
    rest = [c for c in cleaned.columns if c not in (*s.keys, s.order)]
    grouped = member.groupBy(*s.keys, s.order).agg(
        *[F.first(c).alias(c) for c in rest if c != "label"],
        F.array_sort(F.collect_list(info)).alias("_w"))
    texts = {}
    for n in (*numbers, "window_start_time", "window_end_time", *RULE_STATS):
        out = n if n.startswith("window_") else f"window_{n}"
        values = F.col("_w").getField(n)
        shown = F.transform(values, (lambda v: v.cast("string")) if n in numbers else _short)
        texts[out] = _joined(shown)
    return grouped.withColumns(texts).withColumn("window_label", F.lit("normal")).drop("_w")


def extraction_summary(frames: DataFrame, cleaned: DataFrame, normal: DataFrame, windows: DataFrame, size: int,
                       keys: tuple[str, ...], errors: DataFrame | None = None) -> DataFrame:
    """One status row per source series."""
    streams = frames.select(*keys).distinct()
    n_valid = cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    n_frames = normal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f"))
    n_windows = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))
    joined = streams.join(n_valid, list(keys), "left").join(n_frames, list(keys), "left").join(
        n_windows, list(keys), "left")
    if errors is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        joined = joined.join(errors.select(*keys, "error"), list(keys), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error")))
              .when(count("_v") == 0, "no_valid_frames_after_cleaning")
              .when(count("_v") < size, "not_enough_valid_frames")
              .when(count("_f") == 0, "no_normal_frames").otherwise("success"))
    ratio = F.when(count("_v") > 0, half_even(count("_f") / count("_v").cast("double"), 4)).otherwise(F.lit(0.0))
    return joined.select(*keys, count("_v").alias("total_valid_frames"), count("_f").alias("normal_frame_count"),
                         count("_w").alias("normal_window_count"), ratio.alias("normal_ratio"), status.alias("status"))


def confidence_masks() -> dict[str, Column]:
    """Bounds of clear-cut windows. Only the normal mask looks at the label."""
    c = F.col
    return {
        "normal": all_of(c("label") == "normal", c("perclos") <= 0.05, c("mean_ear") >= 0.24, c("std_ear") <= 0.025,
                         c("mean_abs_yaw") <= 12, c("max_abs_yaw") <= 18,
                         c("mean_abs_pitch") <= 7, c("max_abs_pitch") <= 12),
        "drowsiness": all_of(c("perclos") >= 0.20, c("mean_ear") <= 0.20, c("min_ear") <= 0.08,
                             c("mean_abs_yaw") <= 10, c("max_abs_yaw") <= 18),
        "distraction": all_of(c("mean_abs_yaw") >= 18, c("max_abs_yaw") >= 30, c("perclos") <= 0.12),
    }


def high_confidence_filter(windows: DataFrame) -> DataFrame:
    m = confidence_masks()
    return windows.filter(m["normal"] | m["drowsiness"] | m["distraction"])


def feature_columns(feature_set: str) -> list[str]:
    if feature_set == "baseline":
        return list(BASELINE_FEATURES)
    if feature_set == "gaze":
        return [*BASELINE_FEATURES, *GAZE_FEATURES]
    raise ValueError(f"unknown feature set: {feature_set}")


def training_filter(windows: DataFrame, feature_set: str = "baseline", targets: tuple[str, ...] = ("label", "group_id"),
                    ) -> DataFrame:
    """Usable windows with every feature, the label and the group present."""
    kept = windows.filter(F.col("is_usable") == 1)
    if feature_set == "gaze" and "gaze_usable_window" in windows.columns:
        kept = kept.filter(F.col("gaze_usable_window") == 1)
    return kept.na.drop(subset=[*feature_columns(feature_set), *targets])
