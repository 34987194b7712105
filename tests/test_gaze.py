"""Gaze events against plain loops and hand-computed windows."""

import random

import pytest
from pyspark.sql import functions as F

from framelens.config import GazeConfig
from framelens.operators import gaze
from framelens.operators.series import Series
from tests.helpers import LONG, PLANS, SHORT, rows

SAMPLE = "id string, frame long, time_sec double, face_detected int, iris_x_norm double, iris_y_norm double"


def samples(spark, points, frames=None):
    """Samples at 30 per second; a None point has no face."""
    frames = frames or range(1, len(points) + 1)
    data = [("a", f, f / 30.0, int(p is not None), None if p is None else float(p[0]), None if p is None else float(p[1]))
            for f, p in zip(frames, points)]
    return spark.createDataFrame(data, SAMPLE)


def slow_idt(xs, least, limit):
    """Textbook I-DT over one segment."""
    out, at = [], 0
    spread = lambda a, b: max(x for x, _ in xs[a:b]) - min(x for x, _ in xs[a:b]) + max(y for _, y in xs[a:b]) - min(y for _, y in xs[a:b])
    while at + least <= len(xs):
        end = at + least
        if spread(at, end) > limit:
            at += 1
            continue
        while end < len(xs) and spread(at, end + 1) <= limit:
            end += 1
        out.append(end - at)
        at = end
    return out


def test_idt_fold_equals_the_loop(spark):
    rng = random.Random(11)
    data, want = [], {}
    for k in range(120):
        segments = [[(rng.random(), rng.random()) for _ in range(rng.randrange(1, 18))] for _ in range(rng.randrange(1, 4))]
        least = rng.choice([2, 3, 4])
        want[k] = [n for seg in segments for n in slow_idt(seg, least, 0.9)]
        flat = [(j == 0 and i > 0, x, y) for i, seg in enumerate(segments) for j, (x, y) in enumerate(seg)]
        data.append((k, least, flat))
    df = spark.createDataFrame(data, "k int, least int, points array<struct<cut:boolean,x:double,y:double>>")
    got = df.select("k", gaze.idt_lengths(F.col("points"), F.col("least"), 0.9).alias("l")).collect()
    assert {r["k"]: r["l"] for r in got} == want


def window(spark, points, frames=None, size=90, **cfg):
    df = samples(spark, points, frames)
    return [gaze.normal_gaze_windows(df, len(points), s, GazeConfig(**cfg), rounded=True)[0].first().asDict() for s in PLANS]


def test_window_without_valid_rows_has_only_base_columns(spark):
    for row in window(spark, [None, None, None, None]):
        assert row["total_samples"] == 4 and row["valid_samples"] == 0 and row["usable_window"] == 0
        assert row["mean_iris_x_norm"] is None and row["idt_fixation_count"] is None and row["gaze_path_length"] is None


def test_two_valid_rows_are_not_usable(spark):
    for row in window(spark, [(0, 0), (0, 0.3), None]):
        assert row["usable_window"] == 0 and row["gaze_path_length"] == 0.3 and row["gaze_valid_ratio"] == 0.6667


def test_gap_splits_segment(spark):
    """Steps across a frame gap do not count; a single sample forms no event."""
    for row in window(spark, [(0, 0), (1, 0), (5, 0), (6, 0)], frames=[1, 2, 9, 10]):
        assert row["gaze_path_length"] == 2.0 and row["mean_step_distance"] == 1.0


def test_speed_exactly_at_threshold_is_neither_slow_nor_fast(spark):
    """Twenty units per second with unit time steps."""
    data = [("a", i + 1, float(i), 1, 20.0 * i, 0.0) for i in range(6)]
    df = spark.createDataFrame(data, SAMPLE)
    row = gaze.normal_gaze_windows(df, 6, SHORT, GazeConfig(min_duration_ms=2000))[0].first()
    assert row["max_velocity_norm"] == 20.0 and row["rapid_shift_count"] == 0 and row["ivt_fixation_count"] == 0


@pytest.mark.parametrize("fast,count", [(3, 1), (2, 0)])
def test_rapid_run_needs_min_samples_and_may_touch_the_end(spark, fast, count):
    points = [(0.0, 0.0)] * 4
    for i in range(fast):
        points.append((float(i + 1), 0.0))
    for row in window(spark, points):
        assert row["rapid_shift_count"] == count
        assert row["rapid_shift_max_duration_ms"] == (100.0 if count else 0.0)


def test_period_and_step_of_the_whole_series(spark):
    df = samples(spark, [(0, 0)] * 5, frames=[10, 12, 14, 16, 40])
    for s in PLANS:
        assert rows(gaze.frame_step(df, s)) == [("a", 2)]
        assert rows(gaze.sample_period(df, s), 6) == [("a", round(2 / 30, 6))]


def test_zero_time_step_has_zero_speed(spark):
    data = [("a", 1, 1.0, 1, 0.0, 0.0), ("a", 2, 1.0, 1, 1.0, 0.0), ("a", 3, 2.0, 1, 1.0, 0.0)]
    row = gaze.normal_gaze_windows(spark.createDataFrame(data, SAMPLE), 3, SHORT)[0].first()
    assert row["max_velocity_norm"] == 0.0 and row["gaze_path_length"] == 1.0


def test_time_windows_equal_in_both_plans(spark):
    rng = random.Random(2)
    points = [None if rng.random() < 0.1 else (rng.random(), rng.random()) for _ in range(200)]
    df = samples(spark, points)
    cfg = GazeConfig(window_sec=1.0, step_sec=0.5)
    assert rows(gaze.gaze_window_features(df, SHORT, cfg)) == rows(gaze.gaze_window_features(df, LONG, cfg))


def test_select_for_normal_reports_missing_frames(spark):
    df = samples(spark, [(0, 0)] * 4)
    normal = spark.createDataFrame([("a", 2), ("a", 3)], "id string, frame long")
    good, errors = gaze.select_gaze_for_normal(df, normal, SHORT)
    assert [r["frame"] for r in good.orderBy("frame").collect()] == [2, 3] and errors.count() == 0
    good, errors = gaze.select_gaze_for_normal(df, normal.unionByName(spark.createDataFrame([("a", 9)], normal.schema)), SHORT)
    assert good.count() == 0 and rows(errors) == [("a", 1, 9)]


def test_repeated_frame_after_a_gap_opens_the_new_segment(spark):
    """Six samples, a gap, a frame sampled twice and five more: two fixations of six, whatever the input order."""
    frames = [1, 2, 3, 4, 5, 6, 20, 20, 21, 22, 23, 24]
    data = [("a", f, f / 30.0, 1, 0.5, 0.5, i) for i, f in enumerate(frames)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, SAMPLE + ", ordinal long")
        for s in (SHORT, LONG):
            s = Series(s.keys, s.order, s.chunk_rows, "ordinal")
            row = gaze.normal_gaze_windows(df, len(frames), s, GazeConfig(min_duration_ms=100))[0].first()
            assert row["idt_fixation_count"] == 2 and row["idt_fixation_ratio"] == 1.0
            assert row["idt_fixation_max_duration_ms"] == 200.0
