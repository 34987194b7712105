"""Window predictions, per-series verdicts and the stored result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelens.config import LABELS, PRESETS

PROBABILITIES = tuple(f"prob_{label}" for label in LABELS)
# Columns of the result tables.
TIMELINE = ("window_id", "window_start_time", "window_end_time", "predicted_label", *PROBABILITIES,
            "window_risk_score", "perclos_percent", "mean_ear", "max_abs_yaw")


def one_hot(df: DataFrame) -> DataFrame:
    """Probabilities of a model that only gives a label."""
    return df.withColumns({f"prob_{x}": F.when(F.col("predicted_label") == x, 1.0).otherwise(0.0) for x in LABELS})


def complete_probabilities(df: DataFrame) -> DataFrame:
    """A class the model never saw has probability zero."""
    absent = {p: F.lit(0.0) for p in PROBABILITIES if p not in df.columns}
    return df.withColumns(absent) if absent else df


def window_risk(df: DataFrame) -> DataFrame:
    risk = (F.col("prob_drowsiness") + F.col("prob_distraction")) * 100.0
    return df.withColumn("window_risk_score", F.bround(risk, 1))


def first_maximum(values: dict[str, Column]) -> Column:
    """Name of the largest value; on a tie the first name."""
    top = F.greatest(*values.values())
    out = None
    for name, value in values.items():
        out = F.when(value == top, name) if out is None else out.when(value == top, name)
    return out


def stream_verdict(predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One verdict per series from the mean class probabilities of its windows."""
    agg = predictions.groupBy(*keys).agg(
        *[F.avg(p).alias(f"_m_{x}") for p, x in zip(PROBABILITIES, LABELS)],
        *[F.count(F.when(F.col("predicted_label") == x, 1)).alias(f"count_{x}") for x in LABELS],
        F.avg(F.greatest(*PROBABILITIES)).alias("_winner"), F.count(F.lit(1)).alias("usable_window_count"))
    mean = {x: F.col(f"_m_{x}") for x in LABELS}
    named = agg.withColumn("overall_label", first_maximum(mean))
    dominant = F.coalesce(*[F.when(F.col("overall_label") == x, F.col(f"count_{x}")) for x in LABELS])
    to_map = lambda pairs: F.create_map(*[e for k, v in pairs for e in (F.lit(k), v)])
    return named.select(
        *keys, "overall_label", F.bround(F.greatest(*mean.values()), 4).alias("overall_confidence"),
        F.bround((mean["drowsiness"] + mean["distraction"]) * 100.0, 1).alias("risk_score"),
        F.bround("_winner", 4).alias("mean_winner_confidence"), "usable_window_count",
        dominant.alias("dominant_window_count"),
        F.bround(dominant / F.col("usable_window_count").cast("double"), 4).alias("dominant_window_ratio"),
        to_map([(x, F.col(f"count_{x}")) for x in LABELS]).alias("predicted_window_counts"),
        to_map([(x, F.bround(mean[x], 4)) for x in LABELS]).alias("mean_probabilities"))


def scoring_status(streams: DataFrame, windows: DataFrame, verdicts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Every series with its verdict, or with the reason why it has none."""
    has = windows.select(*keys).distinct().withColumn("_w", F.lit(True))
    joined = streams.select(*keys).distinct().join(has, list(keys), "left").join(verdicts, list(keys), "left")
    status = F.when(F.col("overall_label").isNotNull(), "ok").otherwise("error")
    message = (F.when(F.col("_w").isNull(), "no full window").when(F.col("overall_label").isNull(), "no usable window")
               .otherwise(""))
    return joined.withColumns({"status": status, "message": message}).drop("_w")


def clip(frames: DataFrame, mode: str, fps: float = 30.0) -> tuple[DataFrame, str]:
    """Frames and model key of a preset: ``quick`` looks at the first seconds only."""
    preset = PRESETS[mode]
    seconds = preset["clip_seconds"]
    kept = frames if seconds is None else frames.filter(F.col("frame") <= max(1, round(seconds * fps)))
    return kept, preset["model_key"]


def slug_id(slug: Column) -> Column:
    """Stable run id: there is no shared counter on a cluster."""
    return F.conv(F.substring(F.md5(slug), 1, 15), 16, 10).cast("long")


def run_rows(verdicts: DataFrame, quality: DataFrame, keys: tuple[str, ...], *, model_key: str, feature_set: str,
             created_at: Column, fast_mode: bool = True) -> DataFrame:
    """Run header rows; missing numbers become zero."""
    slug = F.concat_ws("_", *keys, F.date_format(created_at, "yyyyMMdd_HHmmss"))
    zero = lambda c, t="double": F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return verdicts.join(quality, list(keys)).select(
        slug_id(slug).alias("id"), slug.alias("analysis_slug"), created_at.alias("created_at"),
        F.col("file_stem").alias("source_video_name"), F.concat_ws("/", *keys).alias("source_video_path"),
        F.col("label").alias("source_label"), F.col("modality").alias("source_modality"),
        F.lit(model_key).alias("model_key"), F.lit(feature_set).alias("feature_set"),
        F.lit(int(fast_mode)).alias("fast_mode"), "overall_label", zero("overall_confidence"), zero("risk_score"),
        zero("total_frames", "long"), zero("detected_face_ratio"), zero("valid_pose_ratio"), zero("valid_ear_ratio"),
        zero("suspicious_ear_ratio"), zero("valid_frame_count", "long"),
        F.to_json("mean_probabilities").alias("mean_probabilities_json"),
        F.to_json(F.create_map(F.lit("windows"), F.concat_ws("/", *keys))).alias("artifacts_json"))


def prediction_rows(predictions: DataFrame, keys: tuple[str, ...], *, created_at: Column) -> DataFrame:
    """Window rows of a run, with the run id as foreign key."""
    slug = F.concat_ws("_", *keys, F.date_format(created_at, "yyyyMMdd_HHmmss"))
    zero = lambda c, t="double": F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    run = slug_id(slug)
    return predictions.select(
        slug_id(F.concat_ws("#", slug, F.col("window_id").cast("string"))).alias("id"), run.alias("analysis_id"),
        "window_id", "window_start_time", "window_end_time", "predicted_label", *[zero(p) for p in PROBABILITIES],
        zero("window_risk_score"), "perclos_percent", "mean_ear", "max_abs_yaw", zero("is_usable", "int"))


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("analysis_slug").desc()).limit(n).select(
        "id", "created_at", "source_video_name", "source_label", "source_modality", "model_key", "overall_label",
        "overall_confidence", "risk_score")


def timeline(predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return predictions.select(*keys, *TIMELINE).orderBy(*keys, "window_start_time")


def timeline_summary(predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Total duration and share of each predicted label per series."""
    n = F.count(F.lit(1)).cast("double")
    return predictions.groupBy(*keys).agg(
        F.max("window_end_time").alias("total_duration"), F.count(F.lit(1)).alias("windows"),
        *[(F.count(F.when(F.col("predicted_label") == x, 1)) / n).alias(f"share_{x}") for x in LABELS])
