"""Window assignment over keyed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelens.operators.series import Series, scan


def _rank(df: DataFrame, s: Series) -> DataFrame:
    """Zero-based position ``_r`` and series length ``_n``."""
    ranked = scan(df, s, running={"_r": F.lit(1)}, totals={"_n": ("sum", F.lit(1))})
    return ranked.withColumn("_r", F.col("_r") - 1)


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(float(by))).cast("long")


def count_windows(df: DataFrame, size: int, s: Series = Series()) -> DataFrame:
    """Blocks of ``size`` consecutive rows; the ragged tail is dropped."""
    ranked = _rank(df, s).withColumn("window_id", _div(F.col("_r"), size) + 1)
    return ranked.filter(F.col("window_id") <= _div(F.col("_n"), size)).drop("_r", "_n")


def count_windows_strict(df: DataFrame, size: int, s: Series = Series()) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``size`` rows of series whose length divides by it, and an error row for the others."""
    ranked = _rank(df, s).withColumn("window_id", _div(F.col("_r"), size) + 1)
    good = ranked.filter(F.col("_n") % size == 0).drop("_r", "_n")
    errors = (df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("row_count"))
              .filter(F.col("row_count") % size != 0)
              .withColumn("error", F.concat(F.lit("row count "), F.col("row_count").cast("string"),
                                            F.lit(f" is not divisible by {size}"))))
    return good, errors


def sliding_count_windows(df: DataFrame, size: int, step: int, s: Series = Series()) -> DataFrame:
    """Every row once per window ``[k*step, k*step + size)`` that lies inside the series; ``window_index`` is k."""
    r, n = F.col("_r"), F.col("_n")
    first = F.greatest(F.lit(0), F.ceil((r - size + 1) / F.lit(float(step))).cast("long"))
    last = F.least(_div(r, step), F.when(n >= size, _div(n - size, step)).otherwise(F.lit(-1)))
    ranked = _rank(df, s).withColumns({"_lo": first, "_hi": last}).filter(F.col("_lo") <= F.col("_hi"))
    return ranked.withColumn("window_index", F.explode(F.sequence("_lo", "_hi"))).drop("_r", "_n", "_lo", "_hi")


def time_windows(df: DataFrame, size: float, step: float | None = None, s: Series = Series(),
                 time: str = "time_sec") -> DataFrame:
    """Full time windows: the first is closed on both ends, later ones open at the start."""
    step = step or size
    t = F.col(time)
    timed = scan(df, s, totals={"_last": ("max", t)}).filter(t >= 0)
    if step == size:
        guess = F.ceil(t / F.lit(float(size))).cast("long")
        exact = (F.when(t <= (guess - 1) * F.lit(float(size)), guess - 1)
                 .when(t > guess * F.lit(float(size)), guess + 1).otherwise(guess))
        placed = timed.withColumn("window_id", F.greatest(exact, F.lit(1)))
    else:
        low = F.greatest(F.lit(0), F.ceil((t - size) / F.lit(float(step))).cast("long") - 1)
        high = F.floor(t / F.lit(float(step))).cast("long") + 1
        placed = timed.withColumn("window_id", F.explode(F.sequence(low + 1, F.greatest(low, high) + 1)))
    start = (F.col("window_id") - 1) * F.lit(float(step))
    end = start + F.lit(float(size))
    inside = ((t > start) | ((F.col("window_id") == 1) & (t >= start))) & (t <= end)
    return (placed.withColumns({"window_start_time": start, "window_end_time": end})
            .filter(inside & (end <= F.col("_last") + F.lit(1e-9))).drop("_last"))


def time_window_count(last_time: Column, size: float, step: float) -> Column:
    """How many full windows fit before ``last_time``."""
    room = F.floor((last_time + F.lit(1e-9) - F.lit(float(size))) / F.lit(float(step))).cast("long") + 1
    return F.coalesce(F.greatest(room, F.lit(0)), F.lit(0))


def attach_frames(frames: DataFrame, windows: DataFrame, s: Series = Series(), *,
                  bucket_frames: int = 1024) -> DataFrame:
    """All frames with ``start_frame <= frame <= end_frame``, through an equi join on frame buckets."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(bucket_frames))).cast("long")
    spread = windows.filter(F.col("start_frame") <= F.col("end_frame")).withColumn(
        "_bucket", F.explode(F.sequence(bucket("start_frame"), bucket("end_frame"))))
    inside = F.col(s.order).between(F.col("start_frame"), F.col("end_frame"))
    return (frames.withColumn("_bucket", bucket(s.order))
            .join(spread, [*s.keys, "_bucket"]).filter(inside).drop("_bucket"))


def assign_valid_windows(df: DataFrame, size: int, valid: Column, s: Series = Series()) -> DataFrame:
    """Windows of ``size`` valid rows with every row between their bounds, in one ordered pass.

    With ``v`` valid rows seen so far, a row lies in window ``(v-1) div size + 1`` unless it is an invalid row
    after that window's last valid row. Frames must be unique per series.
    """
    flagged = df.withColumn("valid", valid)
    one = F.when(F.col("valid"), F.lit(1)).otherwise(F.lit(0))
    seen = scan(flagged, s, running={"_v": one}, totals={"_n": ("sum", one)})
    inside = (F.col("_v") > 0) & (F.col("valid") | (F.col("_v") % size != 0))
    placed = seen.filter(inside).withColumn("window_id", _div(F.col("_v") - 1, size) + 1)
    return placed.filter(F.col("window_id") <= _div(F.col("_n"), size)).drop("_v", "_n")


def perclos_windows(df: DataFrame, size: int, valid: Column, s: Series = Series(),
                    ear_threshold: float = 0.21) -> DataFrame:
    """Bounds and closed-eye share of each window of ``size`` valid rows."""
    return window_bounds(count_windows(df.filter(valid), size, s), s, ear_threshold)


def window_bounds(df: DataFrame, s: Series = Series(), ear_threshold: float = 0.21) -> DataFrame:
    """First and last frame and time, closed-eye count, row count and PERCLOS per window."""
    closed = F.coalesce(F.sum(F.when(F.col("avg_ear") < F.lit(ear_threshold), 1).otherwise(0)), F.lit(0))
    ratio = F.col("closed_eye_frames") / F.col("total_frames").cast("double")
    return df.groupBy(*s.keys, "window_id").agg(
        F.min(s.order).cast("long").alias("start_frame"),
        F.max(s.order).cast("long").alias("end_frame"),
        F.min_by("time_sec", s.order).alias("start_time"),
        F.max_by("time_sec", s.order).alias("end_time"),
        closed.cast("long").alias("closed_eye_frames"),
        F.count(F.lit(1)).alias("total_frames"),
    ).withColumns({"perclos": F.bround(ratio, 4), "perclos_percent": F.bround(ratio * 100.0, 2)})
