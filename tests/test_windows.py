"""Edge rules of cleaning, windows, features and labelling on hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from framelens.config import NormalRule, WindowConfig
from framelens.operators import clean, features, rules, windows
from framelens.operators.series import Series
from tests.helpers import LONG, PLANS, SHORT, frame_rows, rows


def ids(df, *columns):
    return rows(df.select(*columns))


def test_dedupe_keeps_first_and_collapses_null_frames(spark):
    df = frame_rows(spark, [{"frame": 2, "avg_ear": 0.2}, {"frame": 1}, {"frame": 2, "avg_ear": 0.9},
                            {"frame": None, "avg_ear": 0.5}, {"frame": None, "avg_ear": 0.6}])
    out = clean.dedupe_frames(df, SHORT, ordinal="ordinal")
    assert ids(out, "frame", "avg_ear") == sorted([(1, 0.3), (2, 0.2), (None, 0.5)], key=repr)


def test_trim_and_error_rows(spark):
    df = frame_rows(spark, [{"face_detected": 0}, {}, {"face_detected": 0}, {"id": "b", "frame": 1, "face_detected": 0}])
    for s in PLANS:
        kept, errors = clean.trim_to_first_detection(df, s)
        assert ids(kept, "id", "frame") == [("a", 2), ("a", 3)]
        assert ids(errors, "id") == [("b",)]


def test_impute_uses_surviving_rows_and_leaves_empty_columns(spark):
    df = frame_rows(spark, [{"avg_ear": None, "yaw": None}, {"avg_ear": 0.2, "yaw": None}, {"avg_ear": 0.4, "yaw": None}])
    for s in PLANS:
        assert ids(clean.impute_mean(df, s), "avg_ear", "yaw") == [(0.2, None), (0.3, None), (0.4, None)]


def test_zero_durations(spark):
    df = spark.createDataFrame([(0, None), (1, None), (0, 5.0)],
                               "gaze_ivt_fixation_count int, gaze_ivt_fixation_mean_duration_ms double")
    assert rows(clean.fill_zero_duration(df)) == [(0, 0.0), (0, 5.0), (1, None)]


@pytest.mark.parametrize("n,expected", [(89, 0), (90, 1), (179, 1), (180, 2)])
def test_ragged_tail_is_dropped(spark, n, expected):
    df = frame_rows(spark, [{} for _ in range(n)])
    for s in PLANS:
        assert windows.count_windows(df, 90, s).select("window_id").distinct().count() == expected


def test_strict_windows_reject_partial_blocks(spark):
    df = frame_rows(spark, [{} for _ in range(91)] + [{"id": "b", "frame": i} for i in range(90)])
    good, errors = windows.count_windows_strict(df, 90, SHORT)
    assert ids(good.select("id").distinct(), "id") == [("b",)]
    assert ids(errors, "id", "row_count") == [("a", 91)]


@pytest.mark.parametrize("n,size,step", [(23, 5, 2), (23, 5, 5), (23, 4, 7), (3, 5, 2), (10, 5, 5)])
def test_sliding_windows_equal_the_loop(spark, n, size, step):
    df = frame_rows(spark, [{} for _ in range(n)])
    want = [(k, f + 1) for k, start in enumerate(range(0, n - size + 1, step)) for f in range(start, start + size)]
    for s in PLANS:
        assert ids(windows.sliding_count_windows(df, size, step, s), "window_index", "frame") == sorted(want, key=repr)


def test_invalid_rows_join_only_inside_their_window(spark):
    """Windows of two valid rows; invalid rows before, inside, between and after."""
    shape = "i v i v i v v i"
    df = frame_rows(spark, [{"face_detected": 0 if c == "i" else 1} for c in shape.split()])
    for s in PLANS:
        got = ids(windows.assign_valid_windows(df, 2, clean.valid_flag("perclos"), s), "window_id", "frame")
        assert got == [(1, 2), (1, 3), (1, 4), (2, 6), (2, 7)]


def test_fused_pass_equals_range_join(spark):
    pattern = [{"face_detected": int(i * 7 % 5 > 0), "id": "ab"[i % 7 == 0], "frame": i} for i in range(120)]
    df = frame_rows(spark, pattern)
    valid = clean.valid_flag("perclos")
    for s in PLANS:
        bounds = windows.perclos_windows(df, 6, valid, s)
        joined = windows.attach_frames(df, bounds, s, bucket_frames=8)
        assert ids(joined, "id", "window_id", "frame") == ids(windows.assign_valid_windows(df, 6, valid, s), "id", "window_id", "frame")


def test_time_window_bounds(spark):
    """The first window holds time 0; a bound belongs to the earlier window; a last time just short still closes it."""
    times = [0.0, 1.0, 3.0, 3.1, 5.9999999999, 4.0]
    df = frame_rows(spark, [{"time_sec": t} for t in times])
    for s in PLANS:
        got = ids(windows.time_windows(df, 3.0, 3.0, s), "window_id", "time_sec")
        want = [(1, 0.0), (1, 1.0), (1, 3.0), (2, 3.1), (2, 4.0), (2, round(5.9999999999, 9))]
        assert got == sorted(want, key=repr)
    short = df.filter("time_sec < 5")
    assert {r[0] for r in ids(windows.time_windows(short, 3.0, 3.0, SHORT), "window_id")} == {1}


@pytest.mark.parametrize("size", [0.1, 1 / 3, 0.7])
def test_closed_form_equals_the_loop_at_inexact_bounds(spark, size):
    df = frame_rows(spark, [{"time_sec": i * size / 4} for i in range(41)])
    closed = ids(windows.time_windows(df, size, size, SHORT), "window_id", "frame")
    want = []
    last = 40 * size / 4
    for i in range(41):
        t, k = i * size / 4, 1
        while (k - 1) * size + size <= last + 1e-9:
            start, end = (k - 1) * size, (k - 1) * size + size
            if (t > start or (k == 1 and t >= start)) and t <= end:
                want.append((k, i + 1))
            k += 1
    assert closed == sorted(want, key=repr)


def test_gate_uses_unrounded_ratio(spark):
    """0.79995 is shown as 0.8 at four decimals but does not pass the gate."""
    n, lost = 20000, 4001
    df = spark.range(n).select(F.lit("a").alias("id"), (F.col("id") + 1).alias("frame")).withColumns({
        "time_sec": F.col("frame") / 30.0, "face_detected": (F.col("frame") > lost).cast("int"), "pose_valid": F.lit(1),
        "ear_valid": F.lit(1), "yaw": F.lit(0.0), "pitch": F.lit(0.0), "roll": F.lit(0.0), "avg_ear": F.lit(0.3),
        "ear_suspicious": F.lit(0)})
    table, _ = features.normal_window_features(df, SHORT, WindowConfig(size=n))
    row = table.first()
    assert row["face_detect_ratio"] in (0.7999, 0.8) and row["is_usable"] == 0


def test_single_row_and_empty_signals(spark):
    df = frame_rows(spark, [{"yaw": None}])
    row = features.normal_window_features(df, SHORT, WindowConfig(size=1))[0].first()
    assert row["std_ear"] == 0.0 and row["mean_abs_yaw"] is None and row["std_yaw"] is None


def test_missing_suspicious_column_gives_null_ratio(spark):
    df = frame_rows(spark, [{} for _ in range(4)]).drop("ear_suspicious")
    row = features.window_features(df, SHORT, WindowConfig(size=2)).first()
    assert row["ear_suspicious_ratio"] is None and row["is_usable"] == 1


def test_perclos_counts_null_as_open(spark):
    df = frame_rows(spark, [{"avg_ear": 0.1}, {"avg_ear": None}, {"avg_ear": 0.21}, {"avg_ear": 0.3}])
    row = features.normal_window_features(df, SHORT, WindowConfig(size=4))[0].first()
    assert (row["closed_eye_frames"], row["perclos"], row["perclos_percent"]) == (1, 0.25, 25.0)


def test_summary_keeps_null_keys_and_empty_input(spark):
    table = spark.createDataFrame([(None, "IR", 1, 1, 0.1, 0.2, 1.0, 2.0)],
                                  "label string, modality string, window_id int, is_usable int, perclos double, "
                                  "mean_ear double, mean_abs_yaw double, mean_abs_pitch double")
    assert rows(features.summary_by(table)) == [(None, "IR", 1, 1, 0.1, 0.2, 1.0, 2.0)]
    assert features.summary_by(table.limit(0)).count() == 0


def test_quality_of_an_empty_table_is_zero(spark):
    df = frame_rows(spark, [{}]).limit(0)
    assert rows(features.quality_summary(df, ())) == [(0, 0.0, 0.0, 0.0, 0.0, 0, 0.0)]


def test_normal_rule_is_strict_and_fails_on_unknown(spark):
    good = dict(perclos=0.1, mean_ear=0.3, std_ear=0.01, mean_abs_yaw=1.0, mean_abs_pitch=1.0, max_abs_yaw=2.0, max_abs_pitch=2.0)
    cases = [good, {**good, "perclos": 0.15}, {**good, "mean_ear": 0.22}, {**good, "std_ear": None}]
    df = spark.createDataFrame([tuple(c[k] for k in good) for c in cases], ", ".join(f"{k} double" for k in good))
    assert [r[0] for r in df.select(rules.normal_rule(NormalRule())).collect()] == [True, False, False, False]


def test_normal_frames_carry_their_windows(spark):
    df = frame_rows(spark, [{"avg_ear": 0.3 + 0.001 * (i % 2)} for i in range(6)])
    for s in PLANS:
        out = rules.extract_normal_frames(clean.clean_normal_source(df, s), 4, 2, s)
        got = {r["frame"]: (r["window_id"], r["window_start_frame"], r["window_perclos"], r["window_mean_ear"]) for r in out.collect()}
        assert got[1] == ("1", "1", "0", "0.3005") and got[3] == ("1; 2", "1; 3", "0", "0.3005") and len(got) == 6


def test_confidence_filter_keeps_drowsy_row_labelled_normal(spark):
    row = dict(label="normal", perclos=0.5, mean_ear=0.1, min_ear=0.05, std_ear=0.1, mean_abs_yaw=5.0, max_abs_yaw=9.0,
               mean_abs_pitch=5.0, max_abs_pitch=9.0)
    df = spark.createDataFrame([tuple(row.values()), ("normal", None) + (0.1,) * 7],
                               ", ".join(f"{k} {'string' if k == 'label' else 'double'}" for k in row))
    assert rows(rules.high_confidence_filter(df).select("label", "perclos")) == [("normal", 0.5)]


def test_unknown_feature_set():
    assert len(rules.feature_columns("baseline")) == 18 and len(rules.feature_columns("gaze")) == 48
    with pytest.raises(ValueError):
        rules.feature_columns("other")


def test_extraction_status(spark):
    df = frame_rows(spark, [{} for _ in range(6)] + [{"id": "b", "frame": i} for i in range(2)]
                    + [{"id": "c", "frame": 1, "face_detected": 0}] + [{"id": "d", "frame": i, "yaw": 60.0} for i in range(6)])
    cleaned = clean.clean_normal_source(df, SHORT)
    wide = windows.sliding_count_windows(cleaned, 4, 2, SHORT)
    normal = rules.normal_window_table(wide, SHORT)
    chosen = wide.join(normal.select("id", "window_index"), ["id", "window_index"], "left_semi").select("id", "frame").distinct()
    out = rules.extraction_summary(df, cleaned, chosen, normal, 4, ("id",))
    assert {r["id"]: r["status"] for r in out.collect()} == {
        "a": "success", "b": "not_enough_valid_frames", "c": "no_valid_frames_after_cleaning", "d": "no_normal_frames"}


def test_default_series_is_safe_for_long_input():
    assert Series().chunk_rows is not None and LONG.chunk_rows == 7
