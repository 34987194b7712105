"""Registry of the runnable queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelens.operators.series import CHUNK_ROWS, Series, settle
from framelens.sources.events import event_frames, event_series, longest_user, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WINDOW = 10
SIZE_S = 0.5


@dataclass
class Inputs:
    """Lazy access to the stored tables of one folder; the longest series is counted once."""

    spark: SparkSession
    root: str
    limit: int = CHUNK_ROWS

    @cached_property
    def top(self) -> int:
        return longest_user(self.spark, self.root, self.limit)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @cached_property
    def _frames(self) -> DataFrame:
        return settle(event_frames(self.spark, self.root, self.limit, self.top), self.series())

    def frames(self) -> DataFrame:
        return self._frames

    def series(self) -> Series:
        return event_series(self.top, self.limit)


def query(name: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``; doubles are compared at seven decimals."""

    def add(fn):
        def run(spark: SparkSession, root: str, limit: int = CHUNK_ROWS) -> DataFrame:
            return rounded(fn(Inputs(spark, root, limit)))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at seven decimals; the small shift keeps exact decimal ties away from the rounding boundary."""
    return df.select(*[F.round(F.col(c) + F.lit(3e-9), 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- SQL building blocks -------------------------------------------------------------------------------------

K = "label, modality, file_stem"

CTE = {
    "frames": (f"""SELECT label, modality, file_stem, event_id, frame, time_sec, face_detected, pose_valid, ear_valid,
  yaw, pitch, roll, avg_ear, iris_x_norm, iris_y_norm,
  CASE WHEN ear_valid = 1 AND (yaw IS NULL OR abs(yaw) > 35) THEN 1 ELSE 0 END AS ear_suspicious
FROM (SELECT *,
  CASE WHEN pose_valid = 1 THEN (CASE WHEN user_id % 3 = 2 THEN 18 + (event_id * 37) % 43
    ELSE (event_id * 37) % 19 - 9 END)::DOUBLE END AS yaw,
  CASE WHEN pose_valid = 1 THEN ((event_id * 17) % 19 - 9)::DOUBLE END AS pitch,
  CASE WHEN pose_valid = 1 THEN ((event_id * 11) % 21 - 10)::DOUBLE END AS roll,
  CASE WHEN ear_valid = 1 THEN CASE WHEN event_id % 17 = 0 THEN 0.05::DOUBLE
    WHEN user_id % 3 = 1 THEN (value % 35.0::DOUBLE) / 100.0::DOUBLE
    ELSE 0.24::DOUBLE + (value % 10.0::DOUBLE) / 200.0::DOUBLE END END AS avg_ear,
  CASE WHEN face_detected = 1 THEN (value % 100.0::DOUBLE) / 100.0::DOUBLE END AS iris_x_norm,
  CASE WHEN face_detected = 1 THEN ((event_id * 7) % 100) / 100.0::DOUBLE END AS iris_y_norm
FROM (SELECT event_id, user_id, value,
  CASE user_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'drowsiness' ELSE 'distraction' END AS label,
  CASE WHEN user_id % 2 = 0 THEN 'IR' ELSE 'RGB' END AS modality,
  'video_' || user_id AS file_stem,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 30.0::DOUBLE AS time_sec,
  CASE WHEN event_id % 19 = 0 THEN 0 ELSE 1 END AS face_detected,
  CASE WHEN event_id % 19 = 0 OR event_id % 13 = 0 THEN 0 ELSE 1 END AS pose_valid,
  CASE WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN 0 ELSE 1 END AS ear_valid
FROM events))""", ()),
    "valid": (f"""SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY frame) - 1 AS r,
  count(*) OVER (PARTITION BY {K}) AS n FROM frames WHERE face_detected = 1 AND avg_ear IS NOT NULL""", ("frames",)),
    "pw": (f"""SELECT {K}, r // {WINDOW} + 1 AS window_id, min(frame) AS start_frame, max(frame) AS end_frame,
  arg_min(time_sec, frame) AS start_time, arg_max(time_sec, frame) AS end_time,
  count(*) FILTER (avg_ear < 0.21) AS closed_eye_frames, count(*) AS total_frames,
  round_even(count(*) FILTER (avg_ear < 0.21) / count(*), 4) AS perclos,
  round_even(count(*) FILTER (avg_ear < 0.21) / count(*) * 100.0, 2) AS perclos_percent
FROM valid WHERE r // {WINDOW} < n // {WINDOW} GROUP BY {K}, window_id""", ("valid",)),
    "placed": (f"""SELECT f.*, window_id, start_frame, end_frame, start_time, end_time, closed_eye_frames,
  total_frames, perclos, perclos_percent
FROM frames f JOIN pw USING (label, modality, file_stem) WHERE f.frame BETWEEN start_frame AND end_frame""",
               ("frames", "pw")),
    "strict": (f"""SELECT *, r // {WINDOW} + 1 AS window_id FROM (SELECT *,
  row_number() OVER (PARTITION BY {K} ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY {K}) AS n FROM frames)
WHERE n % {WINDOW} = 0""", ("frames",)),
}


def std1(c: str) -> str:
    return f"CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END"


def flag_share(c: str) -> str:
    return f"avg(CASE WHEN {c} = 1 THEN 1.0::DOUBLE ELSE 0.0 END)"


STATS_SQL = ", ".join(
    [f"avg(avg_ear) AS mean_ear, {std1('avg_ear')} AS std_ear, min(avg_ear) AS min_ear, max(avg_ear) AS max_ear"]
    + [f"avg(abs({a})) AS mean_abs_{a}, {std1(a)} AS std_{a}, max(abs({a})) AS max_abs_{a}"
       for a in ("yaw", "pitch", "roll")])
RATIO_SQL = ", ".join(f"{flag_share(f)} AS {n}" for n, f in (
    ("face_detect_ratio", "face_detected"), ("pose_valid_ratio", "pose_valid"),
    ("ear_valid_ratio", "ear_valid"), ("ear_suspicious_ratio", "ear_suspicious")))
USABLE_SQL = "CASE WHEN face_detect_ratio >= 0.8 AND pose_valid_ratio >= 0.8 AND ear_valid_ratio >= 0.8 THEN 1 ELSE 0 END AS is_usable"
RATIOS = ("face_detect_ratio", "pose_valid_ratio", "ear_valid_ratio", "ear_suspicious_ratio")
ROUND_RATIOS = ", ".join(f"round_even({c}, 4) AS {c}" for c in RATIOS)

CTE["wf_raw"] = (f"""SELECT {K}, window_id, any_value(start_frame) AS window_start_frame,
  any_value(end_frame) AS window_end_frame, any_value(start_time) AS window_start_time,
  any_value(end_time) AS window_end_time, any_value(closed_eye_frames) AS closed_eye_frames,
  any_value(total_frames) AS total_frames_perclos, count(*) AS frame_count_source,
  any_value(perclos) AS perclos, any_value(perclos_percent) AS perclos_percent, {RATIO_SQL}, {STATS_SQL}
FROM placed GROUP BY {K}, window_id""", ("placed",))
CTE["wf"] = (f"SELECT * REPLACE ({ROUND_RATIOS}), {USABLE_SQL} FROM wf_raw", ("wf_raw",))
CTE["nwf_raw"] = (f"""SELECT {K}, window_id, min(frame) AS window_start_frame, max(frame) AS window_end_frame,
  arg_min(time_sec, frame) AS window_start_time, arg_max(time_sec, frame) AS window_end_time,
  count(*) FILTER (avg_ear < 0.21) AS closed_eye_frames, count(*) AS total_frames_perclos,
  count(*) AS frame_count_source,
  round_even(count(*) FILTER (avg_ear < 0.21) / count(*), 4) AS perclos,
  round_even(count(*) FILTER (avg_ear < 0.21) / count(*) * 100.0, 2) AS perclos_percent, {RATIO_SQL}, {STATS_SQL}
FROM strict GROUP BY {K}, window_id""", ("strict",))
CTE["nwf"] = (f"SELECT * REPLACE ({ROUND_RATIOS}), {USABLE_SQL} FROM nwf_raw", ("nwf_raw",))

WF_DOUBLES = ("window_start_time", "window_end_time", "perclos", "perclos_percent", *RATIOS,
              "mean_ear", "std_ear", "min_ear", "max_ear",
              *[f"{m}_{a}" for a in ("yaw", "pitch", "roll") for m in ("mean_abs", "std", "max_abs")])


def shown(*columns: str) -> str:
    return ", ".join(f"round({c} + 3e-9, 7) AS {c}" for c in columns)


WF_OUT = (f"{K}, window_id, window_start_frame, window_end_frame, closed_eye_frames, total_frames_perclos, "
          f"frame_count_source, is_usable, {shown(*WF_DOUBLES)}")


#: Mark of a building block that refers to itself.
RECURSIVE = "/* recursive */"


def sql(body: str, *needs: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A query text with the named building blocks it needs in front, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({CTE[n][0]})" for n in order] + [
        f"{n} AS ({t})" for n, t in (extra or {}).items()]
    recursive = recursive or any(CTE[n][0].startswith(RECURSIVE) for n in order)
    return (("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n") if parts else "") + body
