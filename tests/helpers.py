"""Row comparison and small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelens.operators.series import Series

SHORT = Series(("id",), "frame", None)
LONG = Series(("id",), "frame", 7)
PLANS = [SHORT, LONG]

FRAME = ("id string, frame long, time_sec double, face_detected int, pose_valid int, ear_valid int, yaw double, "
         "pitch double, roll double, avg_ear double, ear_suspicious int, ordinal long")


def rows(df: DataFrame, digits: int = 9) -> list[tuple]:
    show = lambda v: round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(show(v) for v in r) for r in df.collect()), key=repr)


def frame_rows(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Frame table from partial rows; what is left out is a valid, calm, open-eyed frame."""
    base = {"id": "a", "face_detected": 1, "pose_valid": 1, "ear_valid": 1, "yaw": 0.0, "pitch": 0.0, "roll": 0.0,
            "avg_ear": 0.3, "ear_suspicious": 0}
    full = []
    for i, item in enumerate(items):
        row = {**base, "ordinal": i, **item}
        row.setdefault("frame", i + 1)
        row.setdefault("time_sec", None if row["frame"] is None else row["frame"] / 30.0)
        full.append(tuple(row[c.split()[0]] for c in FRAME.split(", ")))
    return spark.createDataFrame(full, FRAME)
