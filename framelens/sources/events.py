"""Frame series derived from the ``events`` table, so that every operator can run on stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelens.operators.series import CHUNK_ROWS, Series, longest, ordinal


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _double(value: float):
    return F.lit(float(value))


def longest_user(spark: SparkSession, root: str, limit: int = CHUNK_ROWS) -> int:
    return longest(table(spark, root, "events"), ["user_id"], limit)


def event_frames(spark: SparkSession, root: str, limit: int = CHUNK_ROWS, top: int | None = None) -> DataFrame:
    """One series per user: events in time order play the part of video frames."""
    events = table(spark, root, "events").select("event_id", "ts", "user_id", "value")
    e, k = F.col("event_id"), F.col("user_id") % 3
    face = F.when(e % 19 == 0, 0).otherwise(1)
    pose = F.when((e % 19 == 0) | (e % 13 == 0), 0).otherwise(1)
    eye = F.when((e % 19 == 0) | (e % 23 == 0), 0).otherwise(1)
    yaw = F.when(k == 2, 18 + (e * 37) % 43).otherwise((e * 37) % 19 - 9).cast("double")
    value = F.col("value")
    ear = (F.when(e % 17 == 0, _double(0.05)).when(k == 1, (value % _double(35)) / _double(100))
           .otherwise(_double(0.24) + (value % _double(10)) / _double(200)))
    ranked = ordinal(events, ["user_id"], ["ts", "event_id"], "frame", limit, top)
    flagged = ranked.select(
        F.when(k == 0, "normal").when(k == 1, "drowsiness").otherwise("distraction").alias("label"),
        F.when(F.col("user_id") % 2 == 0, "IR").otherwise("RGB").alias("modality"),
        F.concat(F.lit("video_"), F.col("user_id").cast("string")).alias("file_stem"),
        "event_id", "frame", (F.col("frame") / _double(30)).alias("time_sec"),
        face.alias("face_detected"), pose.alias("pose_valid"), eye.alias("ear_valid"),
        F.when(pose == 1, yaw).alias("yaw"),
        F.when(pose == 1, ((e * 17) % 19 - 9).cast("double")).alias("pitch"),
        F.when(pose == 1, ((e * 11) % 21 - 10).cast("double")).alias("roll"),
        F.when(eye == 1, ear).alias("avg_ear"),
        F.when(face == 1, (value % _double(100)) / _double(100)).alias("iris_x_norm"),
        F.when(face == 1, ((e * 7) % 100) / _double(100)).alias("iris_y_norm"))
    return flagged.withColumn("ear_suspicious", F.when(
        (F.col("ear_valid") == 1) & (F.col("yaw").isNull() | (F.abs("yaw") > 35)), 1).otherwise(0))


def event_series(top: int, limit: int = CHUNK_ROWS) -> Series:
    """Series description of :func:`event_frames`; the plan choice rests on counted rows."""
    return Series(chunk_rows=None if top <= limit else limit)
