"""Queries over cleaning, window and feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.config import FRAME_COLUMNS, SIGNAL_COLUMNS, NormalRule, WindowConfig
from framelens.operators import clean, features, rules, windows
from framelens.operators.audit import quarantine
from framelens.operators.series import Series, stage
from framelens.plans.registry import (
    K, RATIOS, SIZE_S, WF_OUT, WINDOW, CTE, Inputs, flag_share, query, shown, sql, STATS_SQL, RATIO_SQL, USABLE_SQL)

CFG = WindowConfig(size=WINDOW)
KEYS = ["label", "modality", "file_stem"]
SIGNALS = ["avg_ear", "yaw", "pitch", "roll"]


def copies(x: Inputs):
    """Frames with a later, altered copy of every third row."""
    base = x.frames().withColumn("ordinal", F.col("event_id"))
    copy = base.filter(F.col("frame") % 3 == 0).withColumns(
        {"ordinal": F.col("ordinal") + 100_000_000, "avg_ear": F.lit(9.0), "yaw": F.lit(None).cast("double")})
    return base.unionByName(copy)


@query("dedupe_frames", sql(f"""SELECT {K}, frame, event_id, {shown('time_sec', 'avg_ear', 'yaw', 'pitch', 'roll')}
FROM frames""", "frames"))
def _(x):
    """Altered copies lose against the first row per frame, which leaves the frames as they were."""
    kept = clean.dedupe_frames(copies(x), Series(), ordinal="ordinal")
    return kept.select(*KEYS, "frame", "event_id", "time_sec", *SIGNALS)


@query("drop_null_keys", sql(f"SELECT {K}, frame, {shown('avg_ear', 'yaw')} FROM frames WHERE avg_ear IS NOT NULL AND yaw IS NOT NULL", "frames"))
def _(x):
    return clean.drop_null_keys(x.frames(), ["avg_ear", "yaw"]).select(*KEYS, "frame", "avg_ear", "yaw")


@query("trim_to_first_detection", sql(f"""SELECT {K}, frame FROM (SELECT *,
  min(frame) FILTER (face_detected = 1) OVER (PARTITION BY {K}) AS first FROM frames) WHERE frame >= first""", "frames"))
def _(x):
    kept, _ = clean.trim_to_first_detection(x.frames(), x.series())
    return kept.select(*KEYS, "frame")


@query("trim_to_first_usable", sql(f"""SELECT {K}, frame FROM (SELECT *,
  min(frame) FILTER (coalesce(avg_ear, yaw, pitch) IS NOT NULL) OVER (PARTITION BY {K}) AS first FROM frames)
WHERE frame >= first""", "frames"))
def _(x):
    kept, _ = clean.trim_to_first_usable(x.frames(), x.series(), ("avg_ear", "yaw", "pitch"))
    return kept.select(*KEYS, "frame")


IMPUTE_SQL = ", ".join(f"coalesce({c}, avg({c}) OVER (PARTITION BY {K})) AS {c}" for c in SIGNALS)


@query("impute_mean", sql(f"SELECT {K}, frame, {shown(*SIGNALS)} FROM (SELECT {K}, frame, {IMPUTE_SQL} FROM frames)", "frames"))
def _(x):
    return clean.impute_mean(x.frames(), x.series(), SIGNAL_COLUMNS).select(*KEYS, "frame", *SIGNALS)


VALID_SQL = {
    "perclos": "face_detected = 1 AND avg_ear IS NOT NULL",
    "normal": "face_detected = 1 AND pose_valid = 1 AND ear_valid = 1 AND coalesce(ear_suspicious <> 1, true)",
    "normal_audit": "pose_valid = 1 AND ear_valid = 1",
    "gaze": "face_detected = 1 AND iris_x_norm IS NOT NULL AND iris_y_norm IS NOT NULL",
}


@query("valid_frames", sql(" UNION ALL ".join(
    f"SELECT '{m}' AS mode, {K}, frame FROM frames WHERE {c}" for m, c in VALID_SQL.items()), "frames"))
def _(x):
    """One pass that emits a row once per mode it is valid in."""
    modes = F.array(*[F.when(clean.valid_flag(m), F.lit(m)) for m in VALID_SQL])
    return x.frames().select(F.explode(F.array_compact(modes)).alias("mode"), *KEYS, "frame")


@query("fill_zero_duration", sql(f"""SELECT {K}, frame, gaze_rapid_shift_count,
  round(CASE WHEN gaze_rapid_shift_count = 0 AND d IS NULL THEN 0.0 ELSE d END + 3e-9, 7) AS gaze_rapid_shift_mean_duration_ms
FROM (SELECT *, event_id % 4 AS gaze_rapid_shift_count,
  CASE WHEN event_id % 3 <> 0 THEN iris_x_norm END AS d FROM frames)""", "frames"))
def _(x):
    made = x.frames().withColumns({
        "gaze_rapid_shift_count": F.col("event_id") % 4,
        "gaze_rapid_shift_mean_duration_ms": F.when(F.col("event_id") % 3 != 0, F.col("iris_x_norm"))})
    return clean.fill_zero_duration(made).select(
        *KEYS, "frame", "gaze_rapid_shift_count", "gaze_rapid_shift_mean_duration_ms")


@query("align_union", sql(f"""SELECT {K}, frame, round(avg_ear + 3e-9, 7) AS avg_ear, round(yaw + 3e-9, 7) AS yaw FROM
  (SELECT {K}, frame, avg_ear, NULL::DOUBLE AS yaw FROM frames WHERE modality = 'IR'
   UNION ALL SELECT {K}, frame, NULL::DOUBLE, yaw FROM frames WHERE modality = 'RGB')""", "frames"))
def _(x):
    f = x.frames()
    return clean.align_union([f.filter("modality = 'IR'").select(*KEYS, "frame", "avg_ear"),
                              f.filter("modality = 'RGB'").select(*KEYS, "frame", "yaw")])


@query("quarantine", sql(f"""SELECT {K}, CASE WHEN n < 60 THEN 'too few rows' ELSE 'too many lost faces' END AS error
FROM (SELECT {K}, count(*) AS n, {flag_share('face_detected')} AS f FROM frames GROUP BY {K}) WHERE n < 60 OR f < 0.93""", "frames"))
def _(x):
    face = F.avg(F.when(F.col("face_detected") == 1, 1.0).otherwise(0.0))
    _, errors = quarantine(x.frames(), tuple(KEYS), {
        "too few rows": F.count(F.lit(1)) < 60, "too many lost faces": face < 0.93})
    return errors


# --- windows -------------------------------------------------------------------------------------------------

@query("count_windows", sql(f"SELECT {K}, r // {WINDOW} + 1 AS window_id, frame FROM valid WHERE r // {WINDOW} < n // {WINDOW}", "valid"))
def _(x):
    valid = clean.valid_frames(x.frames(), "perclos")
    return windows.count_windows(valid, WINDOW, x.series()).select(*KEYS, "window_id", "frame")


@query("strict_windows", sql(f"""SELECT {K}, window_id, frame, NULL::VARCHAR AS error FROM strict
UNION ALL SELECT {K}, NULL, NULL, 'row count ' || count(*) || ' is not divisible by {WINDOW}' FROM frames
GROUP BY {K} HAVING count(*) % {WINDOW} <> 0""", "strict"))
def _(x):
    good, errors = windows.count_windows_strict(x.frames(), WINDOW, x.series())
    return good.select(*KEYS, "window_id", "frame").unionByName(
        errors.select(*KEYS, "error"), allowMissingColumns=True)


def sliding_sql(step: int) -> str:
    return sql(f"""SELECT {K}, k AS window_index, frame FROM (SELECT *,
  row_number() OVER (PARTITION BY {K} ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY {K}) AS n FROM frames) f,
  range(0, 2000) t(k) WHERE r >= k * {step} AND r < k * {step} + {WINDOW} AND k * {step} + {WINDOW} <= n""", "frames")


@query("sliding_windows", sliding_sql(4))
def _(x):
    return windows.sliding_count_windows(x.frames(), WINDOW, 4, x.series()).select(*KEYS, "window_index", "frame")


@query("gapped_windows", sliding_sql(13))
def _(x):
    return windows.sliding_count_windows(x.frames(), WINDOW, 13, x.series()).select(*KEYS, "window_index", "frame")


def time_sql(step: float) -> str:
    return f"""SELECT f.*, k AS window_id, (k - 1) * {step}::DOUBLE AS w_start, (k - 1) * {step}::DOUBLE + {SIZE_S} AS w_end
FROM (SELECT *, max(time_sec) OVER (PARTITION BY {K}) AS last FROM frames) f, range(1, 2000) t(k)
WHERE (time_sec > (k - 1) * {step}::DOUBLE OR (k = 1 AND time_sec >= 0)) AND time_sec <= (k - 1) * {step}::DOUBLE + {SIZE_S}
  AND (k - 1) * {step}::DOUBLE + {SIZE_S} <= last + 1e-9"""


CTE["tw"] = (time_sql(SIZE_S), ("frames",))
CTE["tw_slide"] = (time_sql(0.25), ("frames",))
TW_OUT = f"SELECT {K}, window_id, frame, round(w_start + 3e-9, 7) AS window_start_time, round(w_end + 3e-9, 7) AS window_end_time"


@query("time_windows", sql(f"{TW_OUT} FROM tw", "tw"))
def _(x):
    return windows.time_windows(x.frames(), SIZE_S, SIZE_S, x.series()).select(
        *KEYS, "window_id", "frame", "window_start_time", "window_end_time")


@query("sliding_time_windows", sql(f"{TW_OUT} FROM tw_slide", "tw_slide"))
def _(x):
    return windows.time_windows(x.frames(), SIZE_S, 0.25, x.series()).select(
        *KEYS, "window_id", "frame", "window_start_time", "window_end_time")


@query("attach_frames", sql(f"SELECT {K}, window_id, frame FROM placed", "placed"))
def _(x):
    f, s = x.frames(), x.series()
    bounds = windows.perclos_windows(f, WINDOW, clean.valid_flag("perclos"), s)
    return windows.attach_frames(f.select(*KEYS, "frame"), bounds, s, bucket_frames=64).select(*KEYS, "window_id", "frame")


def placed(x: Inputs):
    return windows.assign_valid_windows(x.frames(), WINDOW, clean.valid_flag("perclos"), x.series())


@query("assign_valid_windows", sql(f"SELECT {K}, window_id, frame FROM placed", "placed"))
def _(x):
    return placed(x).select(*KEYS, "window_id", "frame")


@query("window_bounds", sql(f"""SELECT {K}, window_id, start_frame, end_frame, closed_eye_frames, total_frames,
  {shown('start_time', 'end_time', 'perclos', 'perclos_percent')} FROM pw""", "pw"))
def _(x):
    return windows.perclos_windows(x.frames(), WINDOW, clean.valid_flag("perclos"), x.series())


# --- features ------------------------------------------------------------------------------------------------

def per_window(x: Inputs, *aggs):
    return placed(x).groupBy(*KEYS, "window_id").agg(*aggs)


@query("perclos", sql(f"""SELECT {K}, window_id, closed_eye_frames, total_frames, perclos, perclos_percent,
  round(closed_eye_frames / total_frames + 3e-9, 7) AS perclos_exact FROM pw""", "pw"))
def _(x):
    bounds = windows.perclos_windows(x.frames(), WINDOW, clean.valid_flag("perclos"), x.series())
    return bounds.select(*KEYS, "window_id", "closed_eye_frames", "total_frames", "perclos", "perclos_percent",
                         (F.col("closed_eye_frames") / F.col("total_frames").cast("double")).alias("perclos_exact"))


@query("quality_ratios", sql(f"SELECT {K}, window_id, {shown(*RATIOS)} FROM wf_raw", "wf_raw"))
def _(x):
    rows = placed(x)
    return rows.groupBy(*KEYS, "window_id").agg(*features.quality_ratios(rows.columns))


@query("ear_stats", sql(f"SELECT {K}, window_id, {shown('mean_ear', 'std_ear', 'min_ear', 'max_ear')} FROM wf_raw", "wf_raw"))
def _(x):
    return per_window(x, *features.ear_stats())


POSE = [f"{m}_{a}" for a in ("yaw", "pitch", "roll") for m in ("mean_abs", "std", "max_abs")]


@query("pose_stats", sql(f"SELECT {K}, window_id, {shown(*POSE)} FROM wf_raw", "wf_raw"))
def _(x):
    return per_window(x, *features.pose_stats())


@query("usable_flag", sql(f"SELECT {K}, window_id, {USABLE_SQL} FROM wf_raw", "wf_raw"))
def _(x):
    rows = placed(x)
    ratios = rows.groupBy(*KEYS, "window_id").agg(*features.quality_ratios(rows.columns))
    return ratios.select(*KEYS, "window_id", features.usable_flag(CFG).alias("is_usable"))


def window_table(x: Inputs):
    return features.window_features(x.frames(), x.series(), CFG)


@query("window_features", sql(f"SELECT {WF_OUT} FROM wf", "wf"))
def _(x):
    return window_table(x)


@query("normal_window_features", sql(f"SELECT {WF_OUT} FROM nwf", "nwf"))
def _(x):
    return features.normal_window_features(x.frames(), x.series(), CFG)[0]


@query("summary_by", sql(f"""SELECT label, modality, count(window_id) AS window_count,
  sum(is_usable)::BIGINT AS usable_window_count, round(avg(perclos) + 3e-9, 7) AS mean_perclos,
  round(avg(mean_ear) + 3e-9, 7) AS mean_ear, round(avg(mean_abs_yaw) + 3e-9, 7) AS mean_abs_yaw,
  round(avg(mean_abs_pitch) + 3e-9, 7) AS mean_abs_pitch FROM wf GROUP BY label, modality""", "wf"))
def _(x):
    return features.summary_by(window_table(x), digits=None)


@query("quality_summary", sql(f"""SELECT {K}, count(*) AS total_frames,
  round({flag_share('face_detected')} + 3e-9, 7) AS detected_face_ratio, round({flag_share('pose_valid')} + 3e-9, 7) AS valid_pose_ratio,
  round({flag_share('ear_valid')} + 3e-9, 7) AS valid_ear_ratio, round({flag_share('ear_suspicious')} + 3e-9, 7) AS suspicious_ear_ratio,
  count(*) FILTER (face_detected = 1 AND avg_ear IS NOT NULL) AS valid_frame_count,
  round(coalesce(count(*) FILTER (face_detected = 1 AND avg_ear < 0.21)
    / nullif(count(*) FILTER (face_detected = 1 AND avg_ear IS NOT NULL), 0), 0.0) + 3e-9, 7) AS stream_perclos
FROM frames GROUP BY {K}""", "frames"))
def _(x):
    return features.quality_summary(x.frames(), tuple(KEYS))


@query("extraction_quality", sql(f"""SELECT {K}, round(count(*) FILTER (face_detected = 0) * 100.0 / count(*) + 3e-9, 7) AS pct_no_face,
  round(count(*) FILTER (face_detected = 1 AND pose_valid = 0) * 100.0 / count(*) + 3e-9, 7) AS pct_pose_invalid,
  round(count(*) FILTER (ear_suspicious = 1) * 100.0 / count(*) + 3e-9, 7) AS pct_ear_suspicious FROM frames GROUP BY {K}""", "frames"))
def _(x):
    return features.extraction_quality(x.frames(), tuple(KEYS))


# --- rules ---------------------------------------------------------------------------------------------------

# Thresholds of the rule.
RULE_SQL = ("perclos < 0.15 AND mean_ear > 0.22 AND std_ear < 0.03 AND mean_abs_yaw < 15 AND mean_abs_pitch < 10 "
            "AND max_abs_yaw < 20 AND max_abs_pitch < 15")


@query("normal_rule", sql(f"SELECT {K}, window_id, coalesce({RULE_SQL}, false) AS is_normal FROM wf", "wf"))
def _(x):
    return window_table(x).select(*KEYS, "window_id", rules.normal_rule(NormalRule()).alias("is_normal"))


CLEAN_COLUMNS = ("time_sec", "yaw", "pitch", "roll", "avg_ear")
STEP = 5
CTE["cleaned"] = (f"""SELECT {K}, frame, {', '.join(f"coalesce({c}, avg({c}) OVER (PARTITION BY {K})) AS {c}" for c in CLEAN_COLUMNS)}
FROM (SELECT *, min(frame) FILTER (frame IS NOT NULL) OVER (PARTITION BY {K}) AS first FROM frames)
WHERE frame >= first AND {VALID_SQL['normal']}""", ("frames",))
CTE["slid"] = (f"""SELECT c.*, k AS window_index FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY frame) - 1 AS r,
  count(*) OVER (PARTITION BY {K}) AS n FROM cleaned) c, range(0, 2000) t(k)
WHERE r >= k * {STEP} AND r < k * {STEP} + {WINDOW} AND k * {STEP} + {WINDOW} <= n""", ("cleaned",))
CTE["normal_w"] = (f"""SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY window_index) AS window_id FROM (
  SELECT {K}, window_index, min(frame) AS window_start_frame, max(frame) AS window_end_frame,
    arg_min(time_sec, frame) AS window_start_time, arg_max(time_sec, frame) AS window_end_time,
    count(*) FILTER (avg_ear < 0.21) / count(*) AS perclos, avg(avg_ear) AS mean_ear, stddev_samp(avg_ear) AS std_ear,
    avg(abs(yaw)) AS mean_abs_yaw, avg(abs(pitch)) AS mean_abs_pitch, max(abs(yaw)) AS max_abs_yaw,
    max(abs(pitch)) AS max_abs_pitch FROM slid GROUP BY {K}, window_index) WHERE {RULE_SQL}""", ("slid",))


def _ordered_unique(c: str, number: bool, out: str) -> str:
    shown = f"{c}::VARCHAR" if number else f"regexp_replace(printf('%.4f', {c}), '\\.?0+$', '')"
    listed = f"list({shown} ORDER BY window_index)"
    return (f"array_to_string(list_filter({listed}, lambda v, i: list_position({listed}, v) = i), '; ') AS {out}")


TEXT_SQL = ", ".join([
    _ordered_unique("window_id", True, "window_id"),
    _ordered_unique("window_start_frame", True, "window_start_frame"),
    _ordered_unique("window_end_frame", True, "window_end_frame"),
    _ordered_unique("window_start_time", False, "window_start_time"),
    _ordered_unique("window_end_time", False, "window_end_time"),
    _ordered_unique("round_even(perclos, 4)", False, "window_perclos"),
    _ordered_unique("max_abs_yaw", False, "window_max_abs_yaw"),
])


@query("extract_normal_frames", sql(f"""SELECT {K}, frame, {TEXT_SQL}, round(any_value(avg_ear) + 3e-9, 7) AS avg_ear
FROM slid JOIN normal_w w USING (label, modality, file_stem, window_index) GROUP BY {K}, frame""", "slid", "normal_w"))
def _(x):
    """Cleaned frames inside normal windows; per-window means are compared by ``normal_windows``."""
    s = x.series()
    cleaned = clean.clean_normal_source(x.frames(), s)
    out = rules.extract_normal_frames(cleaned, WINDOW, STEP, s)
    return out.select(*KEYS, "frame", "window_id", "window_start_frame", "window_end_frame", "window_start_time",
                      "window_end_time", "window_perclos", "window_max_abs_yaw", "avg_ear")


@query("normal_windows", sql(f"""SELECT {K}, window_index, window_id, window_start_frame, window_end_frame,
  {shown('window_start_time', 'window_end_time', *rules.RULE_STATS)} FROM normal_w""", "normal_w"))
def _(x):
    s = x.series()
    cleaned = clean.clean_normal_source(x.frames(), s)
    return rules.normal_window_table(windows.sliding_count_windows(cleaned, WINDOW, STEP, s), s).withColumn(
        "window_id", F.col("window_id").cast("long"))


@query("extraction_summary", sql(f"""SELECT {K}, coalesce(v, 0) AS total_valid_frames, coalesce(f, 0) AS normal_frame_count,
  coalesce(w, 0) AS normal_window_count,
  CASE WHEN coalesce(v, 0) > 0 THEN round_even(coalesce(f, 0) / v, 4) ELSE 0.0 END AS normal_ratio,
  CASE WHEN coalesce(v, 0) = 0 THEN 'no_valid_frames_after_cleaning' WHEN v < {WINDOW} THEN 'not_enough_valid_frames'
    WHEN coalesce(f, 0) = 0 THEN 'no_normal_frames' ELSE 'success' END AS status
FROM (SELECT DISTINCT {K} FROM frames) LEFT JOIN (SELECT {K}, count(*) AS v FROM cleaned GROUP BY {K}) USING ({K})
LEFT JOIN (SELECT {K}, count(DISTINCT frame) AS f FROM slid JOIN normal_w USING ({K}, window_index) GROUP BY {K}) USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS w FROM normal_w GROUP BY {K}) USING ({K})""", "slid", "normal_w"))
def _(x):
    f, s = x.frames(), x.series()
    cleaned = stage(clean.clean_normal_source(f, s))
    wide = windows.sliding_count_windows(cleaned, WINDOW, STEP, s)
    normal_w = stage(rules.normal_window_table(wide, s))
    chosen = wide.join(normal_w.select(*KEYS, "window_index"), [*KEYS, "window_index"], "left_semi").select(
        *KEYS, "frame").distinct()
    return rules.extraction_summary(f, cleaned, chosen, normal_w, WINDOW, tuple(KEYS))


# Thresholds of the high-confidence filter.
HC_SQL = """(label = 'normal' AND perclos <= 0.05 AND mean_ear >= 0.24 AND std_ear <= 0.025 AND mean_abs_yaw <= 12
  AND max_abs_yaw <= 18 AND mean_abs_pitch <= 7 AND max_abs_pitch <= 12)
 OR (perclos >= 0.20 AND mean_ear <= 0.20 AND min_ear <= 0.08 AND mean_abs_yaw <= 10 AND max_abs_yaw <= 18)
 OR (mean_abs_yaw >= 18 AND max_abs_yaw >= 30 AND perclos <= 0.12)"""


@query("high_confidence", sql(f"SELECT {WF_OUT} FROM wf WHERE {HC_SQL}", "wf"))
def _(x):
    return rules.high_confidence_filter(window_table(x))


@query("training_filter", sql(f"""SELECT {WF_OUT}, modality || '::' || file_stem AS group_id FROM wf
WHERE is_usable = 1 AND {' AND '.join(c + ' IS NOT NULL' for c in rules.feature_columns('baseline'))}""", "wf"))
def _(x):
    return rules.training_filter(window_table(x).withColumn("group_id", F.concat_ws("::", "modality", "file_stem")))


@query("feature_set", sql(f"SELECT {K}, window_id, {shown(*rules.feature_columns('baseline'))} FROM wf", "wf"))
def _(x):
    return window_table(x).select(*KEYS, "window_id", *rules.feature_columns("baseline"))
