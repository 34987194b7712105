"""Cleaning: deduplication, trimming, imputation and validity filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framelens.config import EVENT_KINDS, FIRST_USABLE_WIDE, FRAME_COLUMNS, SIGNAL_COLUMNS
from framelens.functions.numeric import all_of, first_non_null, is_one
from framelens.operators.series import Series, scan, settle


def dedupe_frames(df: DataFrame, s: Series = Series(), *, ordinal: str) -> DataFrame:
    """Keep the earliest row per frame by ``ordinal``; null frames collapse to one row.

    An aggregate rather than a window, so copies are merged before the shuffle however many there are.
    """
    rest = [c for c in df.columns if c not in (*s.keys, s.order, ordinal)]
    merged = df.groupBy(*s.keys, s.order).agg(
        F.min(ordinal).alias(ordinal), *[F.min_by(c, ordinal).alias(c) for c in rest])
    return merged.select(*df.columns)


def drop_null_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def trim_to_first(df: DataFrame, s: Series, usable: Column) -> tuple[DataFrame, DataFrame]:
    """Rows from the first usable one on, and an error row for each series that has none."""
    marked = scan(df, s, totals={"_first": ("min", F.when(usable, F.col(s.order)))})
    kept = marked.filter(F.col(s.order) >= F.col("_first")).drop("_first")
    errors = (df.groupBy(*s.keys).agg(F.max(F.coalesce(usable, F.lit(False))).alias("_any"))
              .filter(~F.col("_any")).select(*s.keys, F.lit("no usable row").alias("error")))
    return kept, errors


def trim_to_first_detection(df: DataFrame, s: Series = Series()) -> tuple[DataFrame, DataFrame]:
    return trim_to_first(df, s, is_one("face_detected"))


def trim_to_first_usable(df: DataFrame, s: Series = Series(),
                         columns: tuple[str, ...] = FIRST_USABLE_WIDE) -> tuple[DataFrame, DataFrame]:
    return trim_to_first(df, s, first_non_null([c for c in columns if c in df.columns]).isNotNull())


def impute_mean(df: DataFrame, s: Series = Series(),
                columns: tuple[str, ...] = SIGNAL_COLUMNS) -> DataFrame:
    """Fill nulls with the mean of the series; a column with no value stays null."""
    columns = [c for c in columns if c in df.columns]
    sums = {f"_s_{c}": ("sum", F.col(c).cast("double")) for c in columns}
    counts = {f"_n_{c}": ("sum", F.when(F.col(c).isNotNull(), 1).otherwise(0)) for c in columns}
    filled = scan(df, s, totals={**sums, **counts})
    mean = {c: F.when(F.col(f"_n_{c}") > 0, F.col(f"_s_{c}") / F.col(f"_n_{c}")) for c in columns}
    return filled.select(*[
        F.coalesce(F.col(c).cast("double"), mean[c]).alias(c) if c in mean else F.col(c) for c in df.columns])


def valid_flag(mode: str, has_suspicious: bool = True) -> Column:
    """Row validity: ``perclos``, ``normal``, ``normal_audit`` or ``gaze``."""
    if mode == "perclos":
        return all_of(is_one("face_detected"), F.col("avg_ear").isNotNull())
    if mode == "normal":
        calm = [F.coalesce(F.col("ear_suspicious") != 1, F.lit(True))] if has_suspicious else []
        return all_of(is_one("face_detected"), is_one("pose_valid"), is_one("ear_valid"), *calm)
    if mode == "normal_audit":
        return all_of(is_one("pose_valid"), is_one("ear_valid"))
    if mode == "gaze":
        return all_of(is_one("face_detected"), F.col("iris_x_norm").isNotNull(), F.col("iris_y_norm").isNotNull())
    raise ValueError(f"unknown validity mode: {mode}")


def valid_frames(df: DataFrame, mode: str) -> DataFrame:
    return df.filter(valid_flag(mode, "ear_suspicious" in df.columns))


def clean_normal_source(df: DataFrame, s: Series = Series(), *, ordinal: str | None = None) -> DataFrame:
    """Recipe that feeds normal-frame extraction: trim, validity filter, dedupe, impute every numeric."""
    kept, _ = trim_to_first_usable(df, s)
    valid = valid_frames(kept, "normal")
    if ordinal:
        valid = dedupe_frames(valid, s, ordinal=ordinal)
    return settle(impute_mean(settle(valid, s), s, tuple(c for c in FRAME_COLUMNS if c != s.order)), s)


def clean_normal_audit(df: DataFrame, s: Series = Series()) -> DataFrame:
    """The auditor's own recipe: narrower trim, no face or suspicion test, no dedupe."""
    kept, _ = trim_to_first_usable(df, s, ("avg_ear", "yaw", "pitch"))
    return settle(impute_mean(settle(valid_frames(kept, "normal_audit"), s), s, SIGNAL_COLUMNS), s)


def fill_zero_duration(df: DataFrame, prefix: str = "gaze_") -> DataFrame:
    """A window without events has event durations of zero rather than null."""
    fixes = {}
    for kind in EVENT_KINDS:
        count = f"{prefix}{kind}_count"
        for part in ("mean_duration_ms", "max_duration_ms"):
            name = f"{prefix}{kind}_{part}"
            if count in df.columns and name in df.columns:
                fixes[name] = F.when((F.col(count) == 0) & F.col(name).isNull(), F.lit(0.0)).otherwise(F.col(name))
    return df.withColumns(fixes) if fixes else df


def align_union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
