"""Audits by recomputation, completeness checks and repair."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from framelens.config import AUDIT_COLUMNS, GazeConfig
from framelens.operators.gaze import gaze_window_features
from framelens.operators.series import Series, scan, settle, stage
from framelens.operators.windows import time_window_count

TOLERANCE = 1e-4


def values_match(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Null equals null; numbers match within the tolerance."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(a.isNull() & b.isNull(), True).when(both, F.abs(a - b) <= F.lit(tolerance)).otherwise(False)


def _positions(df: DataFrame, s: Series) -> DataFrame:
    return scan(df, s, running={"position": F.lit(1)})


def diff_windows(actual: DataFrame, expected: DataFrame, s: Series, *, columns: tuple[str, ...] = AUDIT_COLUMNS,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """Windows compared by position; one row per differing window with its first differing column."""
    side = lambda df, p: _positions(df, s).select(*s.keys, "position", *[F.col(c).cast("double").alias(p + c)
                                                                         for c in columns])
    pairs = side(actual, "a_").join(side(expected, "e_"), [*s.keys, "position"])
    differs = {c: ~values_match(F.col("a_" + c), F.col("e_" + c), tolerance) for c in columns}
    first = F.coalesce(*[F.when(differs[c], F.lit(c)) for c in columns])
    pick = lambda p: F.coalesce(*[F.when(F.col("column") == c, F.col(p + c)) for c in columns])
    return (pairs.withColumn("column", first).filter(F.col("column").isNotNull())
            .select(*s.keys, "position", "column", pick("a_").alias("actual"), pick("e_").alias("expected")))


def audit_window_table(actual: DataFrame, expected: DataFrame, sources: DataFrame, s: Series, *,
                       perclos: DataFrame | None = None, columns: tuple[str, ...] = AUDIT_COLUMNS,
                       indivisible: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One status row per series of ``actual``.

    ``sources`` and ``perclos`` list the series whose inputs exist; ``expected`` is the recomputed table;
    ``indivisible`` the series whose rows do not fill whole blocks.
    """
    keys = list(s.keys)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    have = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    diffs = diff_windows(actual, expected, s, columns=columns, tolerance=tolerance)
    problems = diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mismatch_count"),
        F.min(F.struct("position", "column")).alias("_p"))
    table = (count(actual, "window_row_count").join(have(sources, "_src"), keys, "left")
             .join(count(expected, "expected_row_count"), keys, "left").join(problems, keys, "left"))
    table = table.join(have(perclos, "_per"), keys, "left") if perclos is not None else table.withColumn("_per", F.lit(True))
    table = (table.join(have(indivisible, "_odd"), keys, "left") if indivisible is not None
             else table.withColumn("_odd", F.lit(None).cast("boolean")))
    expected_rows = F.coalesce("expected_row_count", F.lit(0))
    status = (F.when(F.col("_src").isNull(), "source_missing").when(F.col("_per").isNull(), "perclos_missing")
              .when(F.col("_odd"), "source_not_divisible")
              .when(F.col("window_row_count") != expected_rows, "row_count_mismatch")
              .when(F.col("mismatch_count") > 0, "value_mismatch").otherwise("exact_match"))
    problem = (F.when(F.col("status") == "row_count_mismatch", "other number of windows than expected")
               .when(F.col("status") == "value_mismatch", F.concat(
                   F.lit("Window "), F.col("_p.position").cast("string"), F.lit(", column '"), F.col("_p.column"),
                   F.lit("'"))).otherwise(""))
    return table.withColumn("status", status).select(
        *keys, "status", "window_row_count", expected_rows.alias("expected_row_count"),
        F.when(F.col("status") == "value_mismatch", F.col("mismatch_count")).otherwise(0).alias("mismatch_count"),
        problem.alias("first_problem"))


def diff_normal_frames(actual: DataFrame, expected: DataFrame, s: Series, *, order: str | None = None) -> DataFrame:
    """Frame lists of the series in ``actual``, compared in order (status) and as sets (missing, extra frames)."""
    keys, order = list(s.keys), order or s.order
    listed = s.ordered(order)
    side = lambda df, name: settle(_positions(df.filter(F.col(s.order).isNotNull()), listed).select(
        *keys, "position", F.col(s.order).alias(name)), s)
    a, e = side(actual, "a"), side(expected, "e")
    in_order = a.join(e, [*keys, "position"], "full").groupBy(*keys).agg(
        F.count("a").alias("actual_rows"), F.count("e").alias("expected_rows"),
        F.max(F.coalesce(F.col("a") != F.col("e"), F.lit(True))).alias("_differs"))
    flag = lambda df, c: df.select(*keys, F.col(c).alias("f")).distinct().withColumn(c, F.lit(True))
    only = flag(a, "a").join(flag(e, "e"), [*keys, "f"], "full")
    missing, extra = F.col("a").isNull(), F.col("e").isNull()
    sets = only.groupBy(*keys).agg(
        F.count(F.when(missing, 1)).alias("missing_frame_count"), F.count(F.when(extra, 1)).alias("extra_frame_count"),
        F.min(F.when(missing, F.col("f"))).alias("first_missing_frame"),
        F.min(F.when(extra, F.col("f"))).alias("first_extra_frame"))
    return in_order.filter("actual_rows > 0").join(sets, keys).withColumn(
        "status", F.when(F.col("_differs"), "frame_mismatch").otherwise("exact_match")).drop("_differs")


def segment_stats(frames: DataFrame, s: Series) -> DataFrame:
    """Number of gap-free segments, longest run of consecutive frames, largest gap above 1 (else 0)."""
    stepped = scan(frames, s, previous={"_before": F.col(s.order)})
    gap = stepped.withColumn("_gap", F.col(s.order) - F.col("_before"))
    broken = F.coalesce(F.col("_gap") != 1, F.lit(False)).cast("int")
    runs = scan(gap, s, running={"_run": broken}).groupBy(*s.keys, "_run").agg(
        F.count(F.lit(1)).alias("_len"), F.count(F.when(F.col("_gap") > 1, 1)).alias("_cuts"),
        F.max(F.when(F.col("_gap") > 1, F.col("_gap"))).alias("_top"))
    return runs.groupBy(*s.keys).agg(
        (F.sum("_cuts") + 1).alias("segment_count"), F.max("_len").alias("longest_segment_frames"),
        F.coalesce(F.max("_top"), F.lit(0)).cast("long").alias("max_frame_gap"))


def expected_rows(total: Column, stride: Column | int) -> Column:
    """Rows that a stride leaves of ``total`` frames; 0 if the total is unknown."""
    stride = F.greatest(F.lit(1), stride if isinstance(stride, Column) else F.lit(stride))
    return F.coalesce(F.when(total > 0, F.floor((total + stride - 1) / stride).cast("long")), F.lit(0))


def is_complete(actual: Column, expected: Column, header_ok: Column) -> Column:
    return F.coalesce(header_ok & (actual == expected) & (actual > 0), F.lit(False))


def audit_row_counts(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...],
                     schema_status: str = "header_mismatch") -> DataFrame:
    """Completeness status of each expected output.

    ``expected`` has ``expected_rows``; ``actual`` has ``actual_rows``, ``readable`` and ``header_ok``.
    """
    both = expected.join(actual.withColumn("_there", F.lit(True)), list(keys), "left")
    n, want = F.coalesce("actual_rows", F.lit(0)), F.col("expected_rows")
    status = (F.when(F.col("_there").isNull(), "missing").when(~F.col("readable"), "unreadable")
              .when(~F.col("header_ok"), schema_status).when(want <= 0, "unknown_expected")
              .when(n == 0, "empty").when(n == want, "complete").when(n < want, "incomplete").otherwise("row_mismatch"))
    counted = F.when(F.col("_there").isNull() | ~F.col("readable"), F.lit(0)).otherwise(n)
    return both.select(*keys, "expected_rows", counted.alias("actual_rows"), status.alias("status"),
                       F.when(want > 0, counted - want).alias("row_delta"))


def audit_windows(samples: DataFrame, outputs: DataFrame, s: Series, cfg: GazeConfig = GazeConfig()) -> DataFrame:
    """Completeness of gaze window tables against the number of full time windows."""
    required = {"window_id", "window_start_time", "window_end_time", "gaze_valid_ratio", "usable_window"}
    expected = samples.groupBy(*s.keys).agg(
        time_window_count(F.max("time_sec"), cfg.window_sec, cfg.step_sec).alias("expected_rows"))
    actual = outputs.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("actual_rows")).withColumns({
        "readable": F.lit(True), "header_ok": F.lit(required <= set(outputs.columns))})
    return audit_row_counts(expected, actual, s.keys, "schema_mismatch")


def repair(samples: DataFrame, outputs: DataFrame, s: Series, cfg: GazeConfig = GazeConfig(), *,
           report_only: bool = False, rounded: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rebuild the window tables that are not complete; returns the tables and a before/after report."""
    keys = list(s.keys)
    before = stage(audit_windows(samples, outputs, s, cfg))
    if report_only:
        return outputs, before.select(*keys, F.col("status").alias("status_before"), F.col("status").alias("status_after"))
    faulty = before.filter("status <> 'complete'").select(*keys)
    rebuilt = stage(gaze_window_features(settle(samples.join(faulty, keys, "left_semi"), s), s, cfg, rounded))
    repaired = outputs.join(faulty, keys, "left_anti").unionByName(rebuilt, allowMissingColumns=True)
    after = audit_windows(samples, repaired, s, cfg)
    report = before.select(*keys, F.col("status").alias("status_before"), F.col("actual_rows").alias("rows_before")).join(
        after.select(*keys, F.col("status").alias("status_after"), F.col("actual_rows").alias("rows_after"),
                     "expected_rows"), keys)
    return repaired, report


def audit_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("series_count")).orderBy("status")


def quarantine(df: DataFrame, keys: tuple[str, ...], rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split series by series-level aggregate rules; each rule is true for a failing series.

    The first failing rule, in the given order, names the error; the other series go on.
    """
    checks = df.groupBy(*keys).agg(*[rule.alias(f"_{i}") for i, rule in enumerate(rules.values())])
    error = F.coalesce(*[F.when(F.col(f"_{i}"), F.lit(text)) for i, text in enumerate(rules)])
    errors = checks.select(*keys, error.alias("error")).filter("error is not null")
    return df.join(errors.select(*keys), list(keys), "left_anti"), errors
