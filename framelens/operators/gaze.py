"""Gaze windows: sampling step, segments, velocity and eye-movement events.

Samples inside one window are bounded by the sensor rate times the window length, so per-window ordered passes
and the array folded for dispersion-based fixations stay small whatever the length of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelens.config import EVENT_KINDS, GazeConfig
from framelens.functions.numeric import count_if, half_even
from framelens.operators.clean import valid_flag
from framelens.operators.series import Series, attach, line_up, median_positive_step, settle
from framelens.operators.windows import count_windows_strict, time_windows


def sample_period(df: DataFrame, s: Series = Series(), cfg: GazeConfig = GazeConfig()) -> DataFrame:
    """Median positive time step of the whole series."""
    return median_positive_step(df, s, "time_sec", cfg.default_period, 0.001).withColumnRenamed("median", "period")


def frame_step(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Median positive frame step, rounded half to even, at least 1."""
    steps = median_positive_step(df, s, s.order, 1.0, 1024.0)
    return steps.select(*s.keys, F.greatest(F.lit(1), F.rint("median").cast("long")).alias("frame_step"))


def with_sampling(samples: DataFrame, s: Series = Series(), cfg: GazeConfig = GazeConfig()) -> DataFrame:
    """Every sample with the ``period`` and ``frame_step`` of its series.

    Short series get both in the ordered pass that the windows use anyway; long ones get them from the reduced tables.
    """
    if s.chunk_rows is not None:
        samples = settle(samples, s)
        return attach(samples, s, sample_period(samples, s, cfg).join(frame_step(samples, s), list(s.keys)))
    step = lambda c: (F.col(c) - F.lag(c).over(Window.partitionBy(*s.keys).orderBy(*line_up(s)))).cast("double")
    whole = Window.partitionBy(*s.keys)
    median = lambda c: F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(0.5)).over(whole)
    stepped = samples.withColumns({"_dt": step("time_sec"), "_df": step(s.order)})
    return stepped.withColumns({
        "period": F.coalesce(median("_dt"), F.lit(float(cfg.default_period))),
        "frame_step": F.greatest(F.lit(1), F.rint(F.coalesce(median("_df"), F.lit(1.0))).cast("long"))}).drop("_dt", "_df")


def min_samples(period: Column, cfg: GazeConfig) -> Column:
    return F.greatest(F.lit(2), F.rint(F.lit(float(cfg.min_duration_ms)) / (period * 1000.0)).cast("int"))


def _cell(s: Series) -> Window:
    """Valid rows of one window in frame order; invalid rows form their own cell and are never looked at."""
    return Window.partitionBy(*s.keys, "window_id", "valid").orderBy(*line_up(s))


def segments(placed: DataFrame, s: Series = Series()) -> DataFrame:
    """Number the runs of valid samples inside a window that no frame gap above ``frame_step`` interrupts."""
    w = _cell(s)
    gap = F.col(s.order) - F.lag(s.order).over(w)
    cut = placed.withColumn("new_segment", F.coalesce(gap > F.col("frame_step"), F.lit(False)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("segment", F.sum(F.col("new_segment").cast("int")).over(upto))


def step_and_velocity(segmented: DataFrame, s: Series = Series()) -> DataFrame:
    """Step distance and speed inside a segment; both null at its first sample."""
    w = _cell(s)
    inside = (F.row_number().over(w) > 1) & ~F.col("new_segment") & F.col("valid")
    delta = lambda c: F.col(c) - F.lag(c).over(w)
    moved = segmented.withColumns({"_in": inside, "_dx": delta("iris_x_norm"), "_dy": delta("iris_y_norm"),
                                   "_dt": delta("time_sec")})
    vx, vy = F.col("_dx") / F.col("_dt"), F.col("_dy") / F.col("_dt")
    speed = F.when(F.col("_dt") > 0, F.sqrt(vx * vx + vy * vy)).otherwise(F.lit(0.0))
    return moved.withColumns({
        "step": F.when(F.col("_in"), F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))),
        "velocity": F.when(F.col("_in"), speed)}).drop("_in", "_dx", "_dy", "_dt")


def velocity_runs(moving: DataFrame, s: Series = Series(), cfg: GazeConfig = GazeConfig()) -> DataFrame:
    """Maximal runs of one speed class per segment: ``slow`` below the threshold, ``fast`` above it.

    The first sample of a segment has no speed and counts as slow. ``run_length`` is set on the last row of a run.
    """
    limit = F.lit(float(cfg.velocity))
    speed = F.coalesce(F.col("velocity"), F.lit(0.0))
    classed = moving.withColumn("speed_class", F.when(speed < limit, "slow").when(speed > limit, "fast").otherwise("at"))
    w = _cell(s)
    changed = F.coalesce(F.lag("speed_class").over(w) != F.col("speed_class"), F.lit(True)) | F.col("new_segment")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = classed.withColumns({"_new": changed, "_at": F.row_number().over(w)})
    start = F.max(F.when(F.col("_new"), F.col("_at"))).over(upto)
    last = F.coalesce(F.lead("_new").over(w), F.lit(True))
    return placed.withColumn("run_length", F.when(last, (F.col("_at") - start + 1).cast("long"))).drop("_new", "_at")


def idt_lengths(points: Column, least: Column, dispersion: float) -> Column:
    """Lengths of dispersion-threshold fixations in an ordered array of ``(new_segment, x, y)`` samples.

    A window of ``least`` samples slides until its spread fits; it then grows until the next sample breaks it.
    """
    point = "struct<x:double,y:double>"
    spread = lambda a: (F.array_max(F.transform(a, lambda p: p["x"])) - F.array_min(F.transform(a, lambda p: p["x"]))
                        + F.array_max(F.transform(a, lambda p: p["y"])) - F.array_min(F.transform(a, lambda p: p["y"])))
    zero = F.lit(0.0)

    def state(held, size, x0, x1, y0, y1, done):
        return F.struct(held.alias("held"), size.alias("size"), x0.alias("x0"), x1.alias("x1"),
                        y0.alias("y0"), y1.alias("y1"), done.alias("done"))

    empty = F.array().cast(f"array<{point}>")
    start = state(empty, F.lit(0), zero, zero, zero, zero, F.array().cast("array<int>"))

    def step(acc, p):
        here = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        x0, x1 = F.least(acc["x0"], p["x"]), F.greatest(acc["x1"], p["x"])
        y0, y1 = F.least(acc["y0"], p["y"]), F.greatest(acc["y1"], p["y"])
        fits = ~p["cut"] & ((x1 - x0) + (y1 - y0) <= F.lit(float(dispersion)))
        closed = F.concat(acc["done"], F.array(acc["size"]))
        held = F.when(p["cut"], F.array(here)).otherwise(F.concat(acc["held"], F.array(here)))
        xs, ys = F.transform(held, lambda q: q["x"]), F.transform(held, lambda q: q["y"])
        return (F.when((acc["size"] > 0) & fits, state(empty, acc["size"] + 1, x0, x1, y0, y1, acc["done"]))
                .when(acc["size"] > 0, state(F.array(here), F.lit(0), zero, zero, zero, zero, closed))
                .when(F.size(held) < least, state(held, F.lit(0), zero, zero, zero, zero, acc["done"]))
                .when(spread(held) <= F.lit(float(dispersion)),
                      state(empty, F.size(held), F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys),
                            acc["done"]))
                .otherwise(state(F.slice(held, F.lit(2), F.size(held) - 1), F.lit(0), zero, zero, zero, zero,
                                 acc["done"])))

    def finish(acc):
        return F.when(acc["size"] > 0, F.concat(acc["done"], F.array(acc["size"]))).otherwise(acc["done"])

    return F.aggregate(points, start, step, finish)


def gaze_runs(placed: DataFrame, s: Series, cfg: GazeConfig = GazeConfig()) -> DataFrame:
    """Every row of the placed windows (sampling columns included) with validity, segment, step, speed and runs."""
    rows = placed.withColumn("valid", valid_flag("gaze"))
    return velocity_runs(step_and_velocity(segments(rows, s), s), s, cfg)


def position_stats() -> list[Column]:
    out = []
    for axis in ("x", "y"):
        at = F.when(F.col("valid"), F.col(f"iris_{axis}_norm"))
        out += [fn(at).alias(f"{name}_iris_{axis}_norm") for name, fn in (
            ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return out


def path_stats() -> list[Column]:
    return [F.sum("step").alias("_path"), F.count("step").alias("_steps"),
            F.avg("velocity").alias("mean_velocity_norm"), F.stddev_pop("velocity").alias("std_velocity_norm"),
            F.max("velocity").alias("max_velocity_norm")]


def event_samples(cfg: GazeConfig) -> list[Column]:
    """Event run lengths of a window, kept as count, sum and maximum."""
    least = min_samples(F.col("period"), cfg)
    out = []
    for kind, speed in (("ivt_fixation", "slow"), ("rapid_shift", "fast")):
        hit = F.when(F.col("valid") & (F.col("speed_class") == speed) & (F.col("run_length") >= least),
                     F.col("run_length"))
        out += [F.count(hit).alias(f"{kind}_count"), F.coalesce(F.sum(hit), F.lit(0)).alias(f"_{kind}_sum"),
                F.max(hit).alias(f"_{kind}_max")]
    return out


def event_durations(df: DataFrame, kinds: tuple[str, ...] = EVENT_KINDS) -> DataFrame:
    """Durations in ms and share of valid samples; durations of a window without events are zero."""
    made = {}
    for kind in kinds:
        n, total, top = F.col(f"{kind}_count"), F.col(f"_{kind}_sum"), F.col(f"_{kind}_max")
        made[f"{kind}_mean_duration_ms"] = F.when(n > 0, total / n.cast("double") * F.col("period") * 1000.0).otherwise(0.0)
        made[f"{kind}_max_duration_ms"] = F.when(n > 0, top.cast("double") * F.col("period") * 1000.0).otherwise(0.0)
        made[f"{kind}_ratio"] = total / F.col("valid_samples").cast("double")
    return df.withColumns(made)


# Decimals of the emitted gaze columns.
DIGITS = {"gaze_valid_ratio": 4, "window_start_time": 3, "window_end_time": 3}
EVENT_DIGITS = {"mean_duration_ms": 3, "max_duration_ms": 3, "ratio": 4}


def gaze_table(runs: DataFrame, s: Series, cfg: GazeConfig, start: Column, end: Column, rounded: bool = True) -> DataFrame:
    """One row per window; the features of a window without a valid row are null."""
    tie = [F.col(s.tie).alias("tie")] if s.tie else []
    point = F.struct(F.col(s.order).alias("at"), *tie, F.col("new_segment").alias("cut"),
                     F.col("iris_x_norm").alias("x"), F.col("iris_y_norm").alias("y"))
    table = runs.groupBy(*s.keys, "window_id").agg(
        start.alias("window_start_time"), end.alias("window_end_time"),
        F.min(s.order).cast("long").alias("window_start_frame"),
        F.max(s.order).cast("long").alias("window_end_frame"),
        F.count(F.lit(1)).alias("total_samples"), count_if(F.col("valid")).alias("valid_samples"),
        F.first("period").alias("period"), *position_stats(), *path_stats(), *event_samples(cfg),
        F.array_sort(F.collect_list(F.when(F.col("valid"), point))).alias("_points"))
    ratio = F.col("valid_samples") / F.col("total_samples").cast("double")
    lengths = idt_lengths(F.col("_points"), min_samples(F.col("period"), cfg), cfg.dispersion)
    table = table.withColumns({
        "gaze_valid_ratio": ratio,
        "usable_window": F.when((ratio >= cfg.min_valid_ratio) & (F.col("valid_samples") >= cfg.min_valid_samples),
                                1).otherwise(0),
        "gaze_dispersion_x": F.col("max_iris_x_norm") - F.col("min_iris_x_norm"),
        "gaze_dispersion_y": F.col("max_iris_y_norm") - F.col("min_iris_y_norm"),
        "gaze_path_length": F.coalesce("_path", F.lit(0.0)),
        "mean_step_distance": F.when(F.col("_steps") > 0, F.col("_path") / F.col("_steps").cast("double")),
        "_idt": lengths}).withColumns({
            "gaze_dispersion_xy": F.col("gaze_dispersion_x") + F.col("gaze_dispersion_y"),
            "idt_fixation_count": F.size("_idt").cast("long"),
            "_idt_fixation_sum": F.aggregate("_idt", F.lit(0), lambda a, b: a + b),
            "_idt_fixation_max": F.array_max("_idt")})
    table = event_durations(table)
    seen = F.col("valid_samples") > 0
    features = ["gaze_path_length"] + [f"{k}_{p}" for k in EVENT_KINDS
                                       for p in ("count", "mean_duration_ms", "max_duration_ms", "ratio")]
    table = table.withColumns({c: F.when(seen, F.col(c)) for c in features})
    if rounded:
        digits = dict(DIGITS)
        digits.update({f"{k}_{p}": d for k in EVENT_KINDS for p, d in EVENT_DIGITS.items()})
        plain = [f"{m}_iris_{a}_norm" for a in "xy" for m in ("mean", "std", "min", "max")]
        plain += ["gaze_dispersion_x", "gaze_dispersion_y", "gaze_dispersion_xy", "gaze_path_length",
                  "mean_step_distance", "mean_velocity_norm", "std_velocity_norm", "max_velocity_norm"]
        digits.update({c: 6 for c in plain})
        table = table.withColumns({c: half_even(F.col(c), d) for c, d in digits.items()})
    return table.drop("period", *[c for c in table.columns if c.startswith("_")])


def gaze_window_features(samples: DataFrame, s: Series = Series(), cfg: GazeConfig = GazeConfig(),
                         rounded: bool = True) -> DataFrame:
    placed = time_windows(with_sampling(samples, s, cfg), cfg.window_sec, cfg.step_sec, s)
    runs = gaze_runs(placed, s, cfg)
    return gaze_table(runs, s, cfg, F.first("window_start_time"), F.first("window_end_time"), rounded)


def normal_gaze_windows(samples: DataFrame, size: int, s: Series = Series(), cfg: GazeConfig = GazeConfig(),
                        rounded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Gaze features of exact blocks of ``size`` samples, and the error rows."""
    blocks, errors = count_windows_strict(with_sampling(samples, s, cfg), size, s)
    runs = gaze_runs(blocks, s, cfg)
    first, last = F.min_by("time_sec", s.order), F.max_by("time_sec", s.order)
    return gaze_table(runs, s, cfg, first, last, rounded), errors


def select_gaze_for_normal(gaze: DataFrame, normal: DataFrame, s: Series = Series()) -> tuple[DataFrame, DataFrame]:
    """Gaze rows at a series' normal frames; a series with a normal frame that gaze lacks is an error row."""
    wanted = normal.select(*s.keys, s.order).na.drop().distinct()
    absent = wanted.join(gaze.select(*s.keys, s.order), [*s.keys, s.order], "left_anti")
    errors = absent.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("missing_frames"),
                                         F.min(s.order).alias("first_missing_frame"))
    picked = gaze.join(wanted, [*s.keys, s.order], "left_semi")
    return picked.join(errors.select(*s.keys), list(s.keys), "left_anti"), errors
