"""Queries over audits: a deterministically altered output table is checked against its recomputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.config import AUDIT_COLUMNS, WindowConfig
from framelens.operators import audit, clean, features, rules, windows
from framelens.operators.series import stage
from framelens.plans.gaze_queries import CFG as GAZE_CFG
from framelens.plans.gaze_queries import UID, gaze_windows
from framelens.plans.registry import CTE, K, SIZE_S, WINDOW, Inputs, query, shown, sql
from framelens.plans.window_queries import KEYS, RULE_SQL, VALID_SQL, window_table

CFG = WindowConfig(size=WINDOW)
def uid():
    return F.substring("file_stem", 7, 20).cast("long")



def altered(table):
    """Shifted ear means, flipped gates, and in some series a missing first window."""
    w = F.col("window_id") + uid()
    return table.withColumns({
        "mean_ear": F.when(w % 7 == 0, F.col("mean_ear") + 0.01).otherwise(F.col("mean_ear")),
        "is_usable": F.when(w % 11 == 0, 1 - F.col("is_usable")).otherwise(F.col("is_usable"))}).filter(
            ~((uid() % 13 == 0) & (F.col("window_id") == 1)))


for _name, _from in (("act", "wf"), ("nact", "nwf")):
    CTE[_name] = (f"""SELECT * REPLACE (CASE WHEN (window_id + {UID}) % 7 = 0 THEN mean_ear + 0.01 ELSE mean_ear END AS mean_ear,
  CASE WHEN (window_id + {UID}) % 11 = 0 THEN 1 - is_usable ELSE is_usable END AS is_usable)
FROM {_from} WHERE NOT ({UID} % 13 = 0 AND window_id = 1)""", (_from,))


def diff_sql(actual: str, expected: str) -> dict[str, str]:
    pos = f"row_number() OVER (PARTITION BY {K} ORDER BY window_id) AS position"
    differs = lambda c: (f"CASE WHEN a.{c} IS NULL AND e.{c} IS NULL THEN false WHEN a.{c} IS NULL OR e.{c} IS NULL THEN true "
                         f"ELSE abs(a.{c} - e.{c}) > 0.0001 END")
    chain = " ".join(f"WHEN {differs(c)} THEN '{c}'" for c in AUDIT_COLUMNS)
    pick = lambda t: "CASE col " + " ".join(f"WHEN '{c}' THEN {t}_{c}::DOUBLE" for c in AUDIT_COLUMNS) + " END"
    both = ", ".join(f"a.{c} AS a_{c}, e.{c} AS e_{c}" for c in AUDIT_COLUMNS)
    return {"diffs": f"""SELECT {K}, position, col AS "column", {pick('a')} AS actual, {pick('e')} AS expected FROM (
  SELECT {K}, position, CASE {chain} END AS col, {both}
  FROM (SELECT *, {pos} FROM {actual}) a JOIN (SELECT *, {pos} FROM {expected}) e USING ({K}, position)) WHERE col IS NOT NULL"""}


@query("diff_windows", sql(f'SELECT {K}, position, "column", {shown("actual", "expected")} FROM diffs', "act", "wf",
                           extra=diff_sql("act", "wf")))
def _(x):
    table = stage(window_table(x))
    return audit.diff_windows(altered(table), table, x.series().ordered("window_id"))


def status_sql(actual: str, expected: str, checks: str) -> str:
    return f"""SELECT {K}, status, window_row_count, expected_row_count,
  CASE WHEN status = 'value_mismatch' THEN m ELSE 0 END AS mismatch_count,
  CASE WHEN status = 'row_count_mismatch' THEN 'other number of windows than expected'
    WHEN status = 'value_mismatch' THEN 'Window ' || p || ', column ''' || c || '''' ELSE '' END AS first_problem
FROM (SELECT a.*, coalesce(e.n, 0) AS expected_row_count, coalesce(m, 0) AS m, p, c,
  CASE {checks} WHEN window_row_count <> coalesce(e.n, 0) THEN 'row_count_mismatch' WHEN coalesce(m, 0) > 0 THEN 'value_mismatch'
    ELSE 'exact_match' END AS status
FROM (SELECT {K}, count(*) AS window_row_count FROM {actual} GROUP BY {K}) a
LEFT JOIN (SELECT {K}, count(*) AS n FROM {expected} GROUP BY {K}) e USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS m, min(position) AS p, arg_min("column", position) AS c FROM diffs GROUP BY {K}) d USING ({K}))"""


AUDIT_SQL = sql(status_sql("act", "wf", f"WHEN {UID} % 17 = 0 THEN 'source_missing' WHEN {UID} % 19 = 0 THEN 'perclos_missing'"),
                "act", "wf", extra=diff_sql("act", "wf"))


def window_audit(x: Inputs):
    f, s = x.frames(), x.series()
    bounds = windows.perclos_windows(f, WINDOW, clean.valid_flag("perclos"), s)
    expected = stage(window_table(x))
    return audit.audit_window_table(altered(expected), expected, f.filter(uid() % 17 != 0).select(*KEYS),
                                    s.ordered("window_id"), perclos=bounds.filter(uid() % 19 != 0).select(*KEYS))


@query("audit_window_table", AUDIT_SQL)
def _(x):
    return window_audit(x)


@query("audit_summary", f"SELECT status, count(*) AS series_count FROM ({AUDIT_SQL}) GROUP BY status")
def _(x):
    return audit.audit_summary(window_audit(x))


@query("self_audit", sql(f"SELECT {K}, 'exact_match' AS status, count(*) AS windows FROM wf GROUP BY {K}", "wf"))
def _(x):
    """The window table audited against a recomputation through the literal range join."""
    f, s = x.frames(), x.series()
    bounds = windows.perclos_windows(f, WINDOW, clean.valid_flag("perclos"), s)
    again = features.features_from_bounds(f, bounds, s, CFG)
    report = audit.audit_window_table(stage(window_table(x)), stage(again), f.select(*KEYS), s.ordered("window_id"), perclos=bounds)
    return report.select(*KEYS, "status", F.col("window_row_count").alias("windows"))


@query("diff_normal_windows", sql(status_sql("nact2", "nwf", f"WHEN {UID} % 17 = 0 THEN 'source_missing' WHEN odd THEN 'source_not_divisible'")
                                  .replace("AS window_row_count FROM", f"AS window_row_count, any_value(odd) AS odd FROM"),
                                  "nact", "nwf", extra={**diff_sql("nact", "nwf"), "nact2": f"""SELECT {K}, false AS odd FROM nact
UNION ALL SELECT {K}, true FROM (SELECT {K} FROM frames GROUP BY {K} HAVING count(*) % {WINDOW} <> 0)"""}))
def _(x):
    """Series that do not fill whole blocks have a one-row stand-in output."""
    f, s = x.frames(), x.series()
    expected, errors = features.normal_window_features(f, s, CFG)
    expected = stage(expected)
    stand_in = errors.select(*KEYS, F.lit(1).cast("long").alias("window_id"))
    actual = altered(expected).unionByName(stand_in, allowMissingColumns=True)
    return audit.audit_window_table(actual, expected, f.filter(uid() % 17 != 0).select(*KEYS), s.ordered("window_id"),
                                    indivisible=errors)


# The auditor's own recipe, which ignores face and suspicion flags.
CTE["acleaned"] = (f"""SELECT {K}, frame, {', '.join(f"coalesce({c}, avg({c}) OVER (PARTITION BY {K})) AS {c}" for c in ("avg_ear", "yaw", "pitch"))}
FROM (SELECT *, min(frame) FILTER (coalesce(avg_ear, yaw, pitch) IS NOT NULL) OVER (PARTITION BY {K}) AS first FROM frames)
WHERE frame >= first AND {VALID_SQL['normal_audit']}""", ("frames",))
CTE["anormal"] = (f"""SELECT {K}, frame FROM (SELECT *, count(*) FILTER (avg_ear < 0.21) OVER w / count(*) OVER w AS perclos,
    avg(avg_ear) OVER w AS mean_ear, stddev_samp(avg_ear) OVER w AS std_ear, avg(abs(yaw)) OVER w AS mean_abs_yaw,
    avg(abs(pitch)) OVER w AS mean_abs_pitch, max(abs(yaw)) OVER w AS max_abs_yaw, max(abs(pitch)) OVER w AS max_abs_pitch
  FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY {K}) AS n FROM acleaned)
  WHERE r // {WINDOW} < n // {WINDOW} WINDOW w AS (PARTITION BY {K}, r // {WINDOW})) WHERE {RULE_SQL}""", ("acleaned",))
CTE["anact"] = (f"""SELECT DISTINCT {K}, frame FROM slid JOIN normal_w USING ({K}, window_index) WHERE window_index % 2 = 0""",
                ("slid", "normal_w"))


def normal_frames(cleaned, s):
    wide = windows.sliding_count_windows(cleaned, WINDOW, WINDOW, s)
    chosen = rules.normal_window_table(wide, s).select(*KEYS, "window_index")
    return wide.join(chosen, [*KEYS, "window_index"], "left_semi").select(*KEYS, "frame")


LIST_SQL = f"SELECT {K}, list(frame ORDER BY frame) AS l FROM"


@query("diff_normal_frames", sql(f"""SELECT {K}, len(a) AS actual_rows, len(e) AS expected_rows,
  CASE WHEN a = e THEN 'exact_match' ELSE 'frame_mismatch' END AS status,
  len(list_filter(e, lambda v: NOT list_contains(a, v))) AS missing_frame_count,
  len(list_filter(a, lambda v: NOT list_contains(e, v))) AS extra_frame_count,
  list_min(list_filter(e, lambda v: NOT list_contains(a, v))) AS first_missing_frame,
  list_min(list_filter(a, lambda v: NOT list_contains(e, v))) AS first_extra_frame
FROM (SELECT {K}, x.l AS a, coalesce(y.l, []) AS e FROM ({LIST_SQL} anact GROUP BY {K}) x
  LEFT JOIN ({LIST_SQL} anormal GROUP BY {K}) y USING ({K}))""", "anact", "anormal"))
def _(x):
    f, s = x.frames(), x.series()
    actual = stage(normal_frames(clean.clean_normal_source(f, s), s))
    return audit.diff_normal_frames(actual, stage(normal_frames(clean.clean_normal_audit(f, s), s)), s)


@query("segment_stats", sql(f"""SELECT {K}, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END)::BIGINT + 1 AS segment_count,
  any_value(longest) AS longest_segment_frames, coalesce(max(gap) FILTER (gap > 1), 0) AS max_frame_gap
FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY {K} ORDER BY frame) AS gap FROM frames WHERE face_detected = 1)
JOIN (SELECT {K}, max(c) AS longest FROM (SELECT {K}, g, count(*) AS c FROM (SELECT *,
  frame - row_number() OVER (PARTITION BY {K} ORDER BY frame) AS g FROM frames WHERE face_detected = 1) GROUP BY {K}, g)
  GROUP BY {K}) USING ({K}) GROUP BY {K}""", "frames"))
def _(x):
    return audit.segment_stats(x.frames().filter("face_detected = 1"), x.series())


@query("expected_rows", sql(f"""SELECT {K}, ((total + 2) // 3)::BIGINT AS expected_rows,
  CASE WHEN total % 2 = 0 AND n = (total + 2) // 3 AND n > 0 THEN true ELSE false END AS complete
FROM (SELECT {K}, count(*) AS total, count(*) FILTER (frame % 3 = 1) AS n FROM frames GROUP BY {K})""", "frames"))
def _(x):
    per = x.frames().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"),
                                        F.count(F.when(F.col("frame") % 3 == 1, 1)).alias("n"))
    want = audit.expected_rows(F.col("total"), 3)
    return per.select(*KEYS, want.alias("expected_rows"),
                      audit.is_complete(F.col("n"), want, F.col("total") % 2 == 0).alias("complete"))


@query("audit_row_counts", sql(f"""SELECT {K}, expected_rows, CASE WHEN u % 13 = 0 OR u % 23 = 0 THEN 0 ELSE n END AS actual_rows,
  CASE WHEN u % 13 = 0 THEN 'missing' WHEN u % 23 = 0 THEN 'unreadable' WHEN u % 7 = 0 THEN 'header_mismatch'
    WHEN expected_rows <= 0 THEN 'unknown_expected' WHEN n = 0 THEN 'empty' WHEN n = expected_rows THEN 'complete'
    WHEN n < expected_rows THEN 'incomplete' ELSE 'row_mismatch' END AS status,
  CASE WHEN expected_rows > 0 THEN CASE WHEN u % 13 = 0 OR u % 23 = 0 THEN 0 ELSE n END - expected_rows END AS row_delta
FROM (SELECT {K}, {UID} AS u, CASE WHEN {UID} % 29 = 0 THEN 0 ELSE (count(*) + 1) // 2 END AS expected_rows,
  CASE WHEN {UID} % 31 = 0 THEN 0 ELSE count(*) FILTER (frame % 2 = 1 AND (event_id % 101 <> 0)) + {UID} % 2 END AS n
  FROM frames GROUP BY {K})""", "frames"))
def _(x):
    f = x.frames()
    per = f.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"), F.count(
        F.when((F.col("frame") % 2 == 1) & (F.col("event_id") % 101 != 0), 1)).alias("n"))
    expected = per.select(*KEYS, F.when(uid() % 29 == 0, 0).otherwise(
        audit.expected_rows(F.col("total"), 2)).alias("expected_rows"))
    actual = per.filter(uid() % 13 != 0).select(
        *KEYS, F.when(uid() % 31 == 0, 0).otherwise(F.col("n") + uid() % 2).alias("actual_rows"),
        (uid() % 23 != 0).alias("readable"), (uid() % 7 != 0).alias("header_ok"))
    return audit.audit_row_counts(expected, actual, tuple(KEYS))


def damaged(x: Inputs):
    """Gaze windows of which some series lost rows, lost all, or gained a copy."""
    table = stage(gaze_windows(x))
    kept = table.filter(~((uid() % 5 == 0) & (F.col("window_id") == 2)) & (uid() % 7 != 0))
    return kept.unionByName(table.filter((uid() % 11 == 0) & (uid() % 7 != 0) & (F.col("window_id") == 1)))


EXPECTED_W = f"greatest(floor((max(time_sec) + 1e-9 - {SIZE_S}) / {SIZE_S})::BIGINT + 1, 0)"
CTE["gaudit"] = (f"""SELECT {K}, expected_rows, coalesce(n, 0) AS actual_rows,
  CASE WHEN n IS NULL THEN 'missing' WHEN expected_rows <= 0 THEN 'unknown_expected' WHEN n = expected_rows THEN 'complete'
    WHEN n < expected_rows THEN 'incomplete' ELSE 'row_mismatch' END AS status
FROM (SELECT {K}, {EXPECTED_W} AS expected_rows FROM frames GROUP BY {K})
LEFT JOIN (SELECT {K}, count(*) AS n FROM (SELECT DISTINCT {K}, window_id FROM tw
    WHERE NOT ({UID} % 5 = 0 AND window_id = 2) AND {UID} % 7 <> 0
  UNION ALL SELECT DISTINCT {K}, window_id FROM tw WHERE {UID} % 11 = 0 AND {UID} % 7 <> 0 AND window_id = 1)
  GROUP BY {K}) USING ({K})""", ("tw",))


@query("audit_windows", sql(f"""SELECT {K}, expected_rows, actual_rows, status,
  CASE WHEN expected_rows > 0 THEN actual_rows - expected_rows END AS row_delta FROM gaudit""", "gaudit"))
def _(x):
    return audit.audit_windows(x.frames(), damaged(x), x.series(), GAZE_CFG)


@query("repair", sql(f"""SELECT {K}, status AS status_before, actual_rows AS rows_before, 'complete' AS status_after,
  expected_rows AS rows_after, expected_rows FROM gaudit""", "gaudit"))
def _(x):
    return audit.repair(x.frames(), damaged(x), x.series(), GAZE_CFG, rounded=False)[1]
