"""Matching, joins and audits."""

import random

import pytest
from pyspark.sql import functions as F

from framelens.config import WindowConfig
from framelens.operators import audit, clean, features, matching, rules
from framelens.operators.series import Series
from tests.helpers import LONG, PLANS, SHORT, frame_rows, rows

SIDE = "label string, modality string, {} string, duration double, rows long"


def sequential(sources, partners, tol):
    """The assignment walked source by source; every row carries the place of its name among its like."""
    listed = {s[2]: sorted(((round(abs(s[3] - p[3]), 6), abs(s[4] - p[4]), p[5]), p[2]) for p in partners
                           if p[:2] == s[:2] and abs(s[3] - p[3]) <= tol) for s in sources}
    turn = lambda s: (len(listed[s[2]]), listed[s[2]][0][0] if listed[s[2]] else (float("inf"),), s[5])
    used, out = set(), {}
    for s in sorted(sources, key=turn):
        free = [p for _, p in listed[s[2]] if p not in used]
        out[s[2]] = free[0] if free else None
        used.update(free[:1])
    return out


@pytest.mark.parametrize("seed,n,m,grid", [(1, 30, 25, 4), (2, 40, 40, 2), (3, 25, 12, 1), (4, 20, 30, 6)])
def test_rounds_equal_the_sequential_walk(spark, seed, n, m, grid):
    """Many equal profiles, ties between shorter and longer partners, and too few partners."""
    rng = random.Random(seed)
    pick = lambda name, place: ("normal", "IR", name, 10.0 + rng.randrange(grid) * 0.5, 300 + rng.randrange(2), place)
    sources = [pick(f"video{i}", i) for i in range(n)]
    lanes = [rng.choice("AB") for _ in range(m)]
    partners = [pick(f"g{lane}_{i % 7}_s{i}" + ("_panel" if i % 4 == 0 else ""), (lane, i % 7, i)) for i, lane in enumerate(lanes)]
    s = spark.createDataFrame([r[:5] for r in sources], SIDE.format("source"))
    p = spark.createDataFrame([r[:5] for r in partners], SIDE.format("partner"))
    want = sequential(sources, partners, 1.0)
    for limit, most in ((10_000, 10_000), (8, 10_000), (10_000, 0), (8, 0), (8, 40)):
        got = matching.greedy_assign(s, p, 1.0, limit=limit, most=most)
        assert {r["source"]: r["partner"] for r in got.collect()} == want
    plain = matching.candidate_summary(s, matching.match_candidates(s, p, 1.0))
    for most in (10_000, 0):
        assert rows(matching.match_summary(s, p, 1.0, most=most).select(plain.columns)) == rows(plain)


def test_components_share_no_candidate(spark):
    rng = random.Random(6)
    sides = [spark.createDataFrame([("a", "IR", f"{name}{i}", rng.choice([1.0, 2.5, 4.0, 9.0, 30.0]) + rng.random(), 10) for i in range(40)], SIDE.format(name))
             for name in ("source", "partner")]
    parts = {r["duration"]: (r["component"], r["size"]) for r in matching.contention(*sides, 1.0).collect()}
    chunked = {r["duration"]: (r["component"], r["size"]) for r in matching.contention(*sides, 1.0, limit=5).collect()}
    assert parts == chunked and len({c for c, _ in parts.values()}) > 1 and sum({c: n for c, n in parts.values()}.values()) == 80
    for a in sides[0].collect():
        for b in sides[1].collect():
            if abs(a["duration"] - b["duration"]) <= 1.0:
                assert parts[a["duration"]][0] == parts[b["duration"]][0]


def test_sources_without_a_place(spark):
    s = spark.createDataFrame([("a", "IR", "v1", None, 3), (None, "IR", "v2", 1.0, 3), ("a", "IR", "v3", 1.0, None), ("a", "IR", "v4", float("nan"), 3)], SIDE.format("source"))
    p = spark.createDataFrame([("a", "IR", "g", None, 3), (None, "IR", "g2", 1.0, 3)], SIDE.format("partner"))
    got = matching.greedy_assign(s, p, 1.0).collect()
    assert {(r["source"], r["status"]) for r in got} == {(f"v{i}", "no candidate") for i in range(1, 5)}
    alone = spark.createDataFrame([("a", "IR", "g3", 1.0, 3)], SIDE.format("partner"))  # a component without a source
    assert matching.greedy_assign(s.limit(0), alone, 1.0).collect() == [] and matching.match_summary(s, p.limit(0), 1.0).count() == 4


def test_halves_round_as_the_column_function(spark):
    import numpy as np

    values = [0.0000005, 0.0000015, 1.0000025, 0.0333335, 2.5, 0.1234565, 7.0000004999]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert matching.rounded(np.array(values)).tolist() == want


def test_unmatched_reasons(spark):
    s = spark.createDataFrame([("a", "IR", "v1", 1.0, 30), ("a", "IR", "v2", 1.0, 30), ("a", "IR", "v3", 99.0, 30)], SIDE.format("source"))
    p = spark.createDataFrame([("a", "IR", "gA_1_s1", 1.5, 45)], SIDE.format("partner"))
    got = {r["source"]: (r["partner"], r["status"]) for r in matching.greedy_assign(s, p, 3.0).collect()}
    assert got == {"v1": ("gA_1_s1", "matched"), "v2": (None, "all taken"), "v3": (None, "no candidate")}


def test_name_keys(spark):
    df = spark.createDataFrame([("gB_12_s3",), ("gA_2_s1_Panel",), ("clip7",)], "n string")
    got = df.select(matching.gaze_name_key(F.col("n")).alias("k"), matching.natural_key(F.col("n")).alias("n2")).collect()
    assert [tuple(r["k"]) for r in got] == [(66, 12, 3, 0, "gB_12_s3"), (65, 2, 1, 1, "gA_2_s1_Panel"), (10**9, 10**9, 10**9, 0, "clip7")]
    assert [tuple(r["n2"]) for r in got] == [(3, "gB_12_s3"), (10**9, "gA_2_s1_Panel"), (7, "clip7")]


def test_one_to_one_join_and_report(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 1)], "id string, window_id int")
    right = spark.createDataFrame([("a", 1, 0.5), ("c", 1, 0.1), ("c", 1, 0.2)], "id string, window_id int, x double")
    merged, errors = matching.one_to_one_left_join(left, right, ("id",))
    assert rows(merged.select("id", "window_id", "gaze_x", "matched")) == [("a", 1, 0.5, True), ("a", 2, None, False)]
    assert rows(errors.select("id", "side")) == [("b", "left"), ("c", "right")]
    report = matching.merge_report(left.filter("id = 'a'"), right.filter("id = 'a'"), merged, ("id",))
    assert rows(report) == [("a", 2, 1, 1, 1, "partial")]


def test_audit_statuses_and_first_problem(spark):
    df = frame_rows(spark, [{"id": k, "frame": i + 1} for k in "abcde" for i in range(4)])
    table = features.window_features(df, SHORT, WindowConfig(size=2))
    broken = table.withColumn("mean_ear", F.when((F.col("id") == "b") & (F.col("window_id") == 2), 0.5).otherwise(F.col("mean_ear")))
    broken = broken.filter(~((F.col("id") == "c") & (F.col("window_id") == 1)))
    report = audit.audit_window_table(broken, table, df.filter("id <> 'd'").select("id"), SHORT.ordered("window_id"),
                                      perclos=df.filter("id <> 'e'").select("id"))
    got = {r["id"]: (r["status"], r["mismatch_count"], r["first_problem"]) for r in report.collect()}
    assert got["a"] == ("exact_match", 0, "") and got["b"] == ("value_mismatch", 1, "Window 2, column 'mean_ear'")
    assert got["c"][0] == "row_count_mismatch" and got["d"][0] == "source_missing" and got["e"][0] == "perclos_missing"


def test_tolerance_and_null_equality(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (1.0, 1.00005), (1.0, 1.001)], "a double, b double")
    assert [r[0] for r in df.select(audit.values_match(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_frame_diff_is_order_sensitive(spark):
    make = lambda frames: spark.createDataFrame([("a", f, i) for i, f in enumerate(frames)], "id string, frame long, at long")
    expected = make([1, 2, 3])
    for s in PLANS:
        for frames, status, missing, extra in (([1, 2, 3], "exact_match", 0, 0), ([2, 1, 3], "frame_mismatch", 0, 0), ([1, 3, 5], "frame_mismatch", 1, 1)):
            row = audit.diff_normal_frames(make(frames), expected, s, order="at").first()
            assert (row["status"], row["missing_frame_count"], row["extra_frame_count"]) == (status, missing, extra)


def test_segments_with_duplicates_and_gaps(spark):
    df = spark.createDataFrame([("a", f) for f in (1, 2, 3, 7, 8, 20)], "id string, frame long")
    for s in PLANS:
        assert rows(audit.segment_stats(df, s)) == [("a", 3, 3, 12)]


def test_completeness_statuses_in_order(spark):
    expected = spark.createDataFrame([(k, n) for k, n in (("a", 3), ("b", 3), ("c", 3), ("d", 0), ("e", 3), ("f", 3), ("g", 3), ("h", 3))], "id string, expected_rows long")
    actual = spark.createDataFrame([("b", 9, False, True), ("c", 3, True, False), ("d", 3, True, True), ("e", 0, True, True),
                                    ("f", 3, True, True), ("g", 2, True, True), ("h", 4, True, True)],
                                   "id string, actual_rows long, readable boolean, header_ok boolean")
    got = {r["id"]: (r["status"], r["row_delta"]) for r in audit.audit_row_counts(expected, actual, ("id",)).collect()}
    assert got == {"a": ("missing", -3), "b": ("unreadable", -3), "c": ("header_mismatch", 0), "d": ("unknown_expected", None),
                   "e": ("empty", -3), "f": ("complete", 0), "g": ("incomplete", -1), "h": ("row_mismatch", 1)}


def test_expected_rows(spark):
    df = spark.createDataFrame([(10, 3), (9, 3), (0, 3), (None, 3), (7, 0)], "n long, k int")
    assert [r[0] for r in df.select(audit.expected_rows(F.col("n"), F.col("k"))).collect()] == [4, 3, 0, 0, 7]


def test_quarantine_names_the_first_failing_rule(spark):
    df = frame_rows(spark, [{"id": "a"}, {"id": "a"}, {"id": "b", "avg_ear": None}])
    good, errors = audit.quarantine(df, ("id",), {"short": F.count(F.lit(1)) < 2, "blind": F.count("avg_ear") == 0})
    assert rows(good.select("id").distinct()) == [("a",)] and rows(errors) == [("b", "short")]


def test_producer_and_auditor_recipes_differ_on_suspicious_frames(spark):
    df = frame_rows(spark, [{"ear_suspicious": int(i == 1)} for i in range(5)])
    assert clean.clean_normal_source(df, SHORT).count() == 4 and clean.clean_normal_audit(df, SHORT).count() == 5
