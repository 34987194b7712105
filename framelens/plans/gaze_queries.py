"""Queries over gaze series, event detection, matching and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.config import EVENT_COLUMNS, GAZE_STAT_COLUMNS, GazeConfig
from framelens.operators import features, gaze, matching, rules, windows
from framelens.operators.clean import clean_normal_source
from framelens.operators.series import stage
from framelens.plans.registry import CTE, K, SIZE_S, WINDOW, Inputs, query, shown, sql
from framelens.plans.window_queries import KEYS, window_table

CFG = GazeConfig(window_sec=SIZE_S, step_sec=SIZE_S)

CTE["period"] = (f"""SELECT {K}, coalesce(median(dt) FILTER (dt > 0), 1.0 / 30.0) AS period,
  greatest(1, round_even(coalesce(median(df) FILTER (df > 0), 1.0), 0))::BIGINT AS frame_step
FROM (SELECT {K}, time_sec - lag(time_sec) OVER w AS dt, frame - lag(frame) OVER w AS df FROM frames
      WINDOW w AS (PARTITION BY {K} ORDER BY frame)) GROUP BY {K}""", ("frames",))


def _motion(source: str, prefix: str) -> None:
    """Valid samples of the windows of ``source`` with segments, speeds and runs."""
    C = f"{K}, window_id"
    CTE[f"{prefix}seg"] = (f"""SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY {C} ORDER BY frame) AS segment
FROM (SELECT t.*, period, frame_step, greatest(2, round_even(100.0 / (period * 1000.0), 0))::INT AS least,
    coalesce(frame - lag(frame) OVER (PARTITION BY {C} ORDER BY frame) > frame_step, false) AS cut
  FROM {source} t JOIN period USING ({K}) WHERE face_detected = 1 AND iris_x_norm IS NOT NULL AND iris_y_norm IS NOT NULL)""",
                           (source, "period"))
    CTE[f"{prefix}move"] = (f"""SELECT *, sqrt(dx * dx + dy * dy) AS step,
  CASE WHEN dt > 0 THEN sqrt((dx / dt) * (dx / dt) + (dy / dt) * (dy / dt)) WHEN dx IS NOT NULL THEN 0.0 END AS velocity
FROM (SELECT *, iris_x_norm - lag(iris_x_norm) OVER s AS dx, iris_y_norm - lag(iris_y_norm) OVER s AS dy,
    time_sec - lag(time_sec) OVER s AS dt FROM {prefix}seg
  WINDOW s AS (PARTITION BY {C}, segment ORDER BY frame))""", (f"{prefix}seg",))
    CTE[f"{prefix}runs"] = (f"""SELECT {C}, segment, kind, g, any_value(period) AS period, any_value(least) AS least, count(*) AS len
FROM (SELECT *, row_number() OVER (PARTITION BY {C}, segment ORDER BY frame)
    - row_number() OVER (PARTITION BY {C}, segment, kind ORDER BY frame) AS g
  FROM (SELECT *, CASE WHEN coalesce(velocity, 0) < 20 THEN 'slow' WHEN velocity > 20 THEN 'fast' ELSE 'at' END AS kind
        FROM {prefix}move)) GROUP BY {C}, segment, kind, g""", (f"{prefix}move",))
    CTE[f"{prefix}list"] = (f"""SELECT {C}, segment, any_value(least) AS least, count(*) AS n,
  list(iris_x_norm ORDER BY frame) AS xs, list(iris_y_norm ORDER BY frame) AS ys FROM {prefix}seg GROUP BY {C}, segment""",
                            (f"{prefix}seg",))


_motion("tw", "t_")
_motion("strict", "s_")


def spread(a: str, b: str) -> str:
    return (f"(list_max(list_slice(xs, {a}, {b})) - list_min(list_slice(xs, {a}, {b})) + "
            f"list_max(list_slice(ys, {a}, {b})) - list_min(list_slice(ys, {a}, {b})))")


def idt_sql(prefix: str) -> dict[str, str]:
    """Dispersion fixations by jumping from start to start: a fitting start jumps past its fixation."""
    C = f"{K}, window_id"
    grow = f"len(list_filter(range(pos + least - 1, n + 1), lambda e: {spread('pos', 'e')} <= 1.0)) + least - 1"
    fits = f"{spread('pos', 'pos + least - 1')} <= 1.0"
    size = f"CASE WHEN pos + least - 1 <= n AND {fits} THEN {grow} ELSE 0 END"
    return {f"{prefix}walk": f"""SELECT {C}, segment, xs, ys, n, least, pos, {size} AS size FROM (SELECT *, 1::BIGINT AS pos FROM {prefix}list)
UNION ALL SELECT {C}, segment, xs, ys, n, least, pos, {size} AS size FROM (
  SELECT {C}, segment, xs, ys, n, least, pos + greatest(size, 1) AS pos FROM {prefix}walk WHERE pos + least - 1 <= n)"""}


def event_sql(prefix: str) -> dict[str, str]:
    C = f"{K}, window_id"
    walk = idt_sql(prefix)
    return {**walk,
            f"{prefix}idt": f"SELECT {C}, count(*) AS idt_n, sum(size) AS idt_s, max(size) AS idt_m FROM {prefix}walk WHERE size > 0 GROUP BY {C}",
            f"{prefix}vel": f"""SELECT {C}, count(*) FILTER (kind = 'slow' AND len >= least) AS ivt_n,
  sum(len) FILTER (kind = 'slow' AND len >= least) AS ivt_s, max(len) FILTER (kind = 'slow' AND len >= least) AS ivt_m,
  count(*) FILTER (kind = 'fast' AND len >= least) AS rap_n, sum(len) FILTER (kind = 'fast' AND len >= least) AS rap_s,
  max(len) FILTER (kind = 'fast' AND len >= least) AS rap_m FROM {prefix}runs GROUP BY {C}"""}


def event_columns(short: str, kind: str) -> str:
    v = f"CASE WHEN valid_samples > 0 THEN"
    return f"""{v} coalesce({short}_n, 0) END AS {kind}_count,
  round({v} coalesce({short}_s / {short}_n * period * 1000.0, 0.0) END + 3e-9, 7) AS {kind}_mean_duration_ms,
  round({v} coalesce({short}_m * period * 1000.0, 0.0) END + 3e-9, 7) AS {kind}_max_duration_ms,
  round({v} coalesce({short}_s, 0)::DOUBLE / valid_samples END + 3e-9, 7) AS {kind}_ratio"""


def gaze_sql(source: str, prefix: str, start: str, end: str) -> str:
    C = f"{K}, window_id"
    valid = "face_detected = 1 AND iris_x_norm IS NOT NULL AND iris_y_norm IS NOT NULL"
    pos = ", ".join(f"{fn}(iris_{a}_norm) FILTER ({valid}) AS {m}_iris_{a}_norm" for a in "xy" for m, fn in (
        ("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    extra = {
        **event_sql(prefix),
        "base": f"""SELECT {C}, {start} AS window_start_time, {end} AS window_end_time, min(frame) AS window_start_frame,
  max(frame) AS window_end_frame, count(*) AS total_samples, count(*) FILTER ({valid}) AS valid_samples, {pos}
FROM {source} GROUP BY {C}""",
        "path": f"""SELECT {C}, sum(step) AS p, count(step) AS steps, avg(velocity) AS mean_velocity_norm,
  stddev_pop(velocity) AS std_velocity_norm, max(velocity) AS max_velocity_norm FROM {prefix}move GROUP BY {C}""",
    }
    stats = shown(*[c for c in GAZE_STAT_COLUMNS if c not in ("gaze_path_length", "mean_step_distance") and "dispersion" not in c])
    body = f"""SELECT {C}, window_start_frame, window_end_frame, total_samples, valid_samples,
  round(window_start_time + 3e-9, 7) AS window_start_time, round(window_end_time + 3e-9, 7) AS window_end_time,
  round(valid_samples / total_samples + 3e-9, 7) AS gaze_valid_ratio,
  CASE WHEN valid_samples / total_samples >= 0.5 AND valid_samples >= 3 THEN 1 ELSE 0 END AS usable_window, {stats},
  round(max_iris_x_norm - min_iris_x_norm + 3e-9, 7) AS gaze_dispersion_x,
  round(max_iris_y_norm - min_iris_y_norm + 3e-9, 7) AS gaze_dispersion_y,
  round(max_iris_x_norm - min_iris_x_norm + max_iris_y_norm - min_iris_y_norm + 3e-9, 7) AS gaze_dispersion_xy,
  round(CASE WHEN valid_samples > 0 THEN coalesce(p, 0.0) END + 3e-9, 7) AS gaze_path_length,
  round(p / nullif(steps, 0) + 3e-9, 7) AS mean_step_distance,
  {event_columns('idt', 'idt_fixation')}, {event_columns('ivt', 'ivt_fixation')}, {event_columns('rap', 'rapid_shift')}
FROM base JOIN period USING ({K}) LEFT JOIN path USING ({C}) LEFT JOIN {prefix}idt USING ({C}) LEFT JOIN {prefix}vel USING ({C})"""
    return sql(body, f"{prefix}move", f"{prefix}runs", f"{prefix}list", extra=extra, recursive=True)


def moving(x: Inputs):
    """Placed gaze samples with every derived column."""
    f, s = x.frames(), x.series()
    return gaze.gaze_runs(windows.time_windows(gaze.with_sampling(f, s, CFG), SIZE_S, SIZE_S, s), s, CFG), s


@query("sample_period", sql(f"SELECT {K}, {shown('period')} FROM period", "period"))
def _(x):
    return gaze.sample_period(x.frames(), x.series(), CFG)


@query("frame_step", sql(f"SELECT {K}, frame_step FROM (SELECT {K}, frame_step FROM period)", "period"))
def _(x):
    return gaze.frame_step(x.frames(), x.series())


@query("segments", sql(f"SELECT {K}, window_id, frame, segment::BIGINT AS segment FROM t_seg", "t_seg"))
def _(x):
    return moving(x)[0].filter("valid").select(*KEYS, "window_id", "frame", "segment")


@query("step_and_velocity", sql(f"SELECT {K}, window_id, frame, {shown('step', 'velocity')} FROM t_move", "t_move"))
def _(x):
    return moving(x)[0].filter("valid").select(*KEYS, "window_id", "frame", "step", "velocity")


@query("ivt_fixations", sql(f"SELECT {K}, window_id, segment::BIGINT AS segment, len AS samples FROM t_runs WHERE kind = 'slow' AND len >= least", "t_runs"))
def _(x):
    runs, _ = moving(x)
    hit = F.col("valid") & (F.col("speed_class") == "slow") & (F.col("run_length") >= gaze.min_samples(F.col("period"), CFG))
    return runs.filter(hit).select(*KEYS, "window_id", "segment", F.col("run_length").alias("samples"))


@query("rapid_shifts", sql(f"SELECT {K}, window_id, segment::BIGINT AS segment, len AS samples FROM t_runs WHERE kind = 'fast' AND len >= least", "t_runs"))
def _(x):
    runs, _ = moving(x)
    hit = F.col("valid") & (F.col("speed_class") == "fast") & (F.col("run_length") >= gaze.min_samples(F.col("period"), CFG))
    return runs.filter(hit).select(*KEYS, "window_id", "segment", F.col("run_length").alias("samples"))


def gaze_windows(x: Inputs):
    return gaze.gaze_window_features(x.frames(), x.series(), CFG, rounded=False)


FULL_SQL = gaze_sql("tw", "t_", "any_value(w_start)", "any_value(w_end)")
POSITION = [c for c in GAZE_STAT_COLUMNS if "iris" in c or "dispersion" in c]
PATH = [c for c in GAZE_STAT_COLUMNS if c not in POSITION]


def part(columns) -> str:
    return f"SELECT {K}, window_id, {', '.join(columns)} FROM ({FULL_SQL})"


@query("gaze_position_stats", part(POSITION))
def _(x):
    return gaze_windows(x).select(*KEYS, "window_id", *POSITION)


@query("path_and_velocity_stats", part(PATH))
def _(x):
    return gaze_windows(x).select(*KEYS, "window_id", *PATH)


@query("idt_fixations", sql(f"SELECT {K}, window_id, idt_n AS idt_fixation_count, idt_s::BIGINT AS samples FROM t_idt", "t_list",
                            extra={k: v for k, v in event_sql("t_").items() if "vel" not in k}, recursive=True))
def _(x):
    runs, s = moving(x)
    point = F.struct(F.col("frame").alias("at"), F.col("new_segment").alias("cut"),
                     F.col("iris_x_norm").alias("x"), F.col("iris_y_norm").alias("y"))
    held = runs.filter("valid").groupBy(*KEYS, "window_id").agg(
        F.first("period").alias("period"), F.array_sort(F.collect_list(point)).alias("points"))
    lengths = gaze.idt_lengths(F.col("points"), gaze.min_samples(F.col("period"), CFG), CFG.dispersion)
    return held.select(*KEYS, "window_id", lengths.alias("l")).filter(F.size("l") > 0).select(
        *KEYS, "window_id", F.size("l").cast("long").alias("idt_fixation_count"),
        F.aggregate("l", F.lit(0), lambda a, b: a + b).cast("long").alias("samples"))


@query("event_durations", part(EVENT_COLUMNS))
def _(x):
    return gaze_windows(x).select(*KEYS, "window_id", *EVENT_COLUMNS)


@query("gaze_window_features", FULL_SQL)
def _(x):
    return gaze_windows(x)


@query("normal_gaze_windows", gaze_sql("strict", "s_", "arg_min(time_sec, frame)", "arg_max(time_sec, frame)"))
def _(x):
    return gaze.normal_gaze_windows(x.frames(), WINDOW, x.series(), CFG, rounded=False)[0]


@query("gaze_stream_summary", f"""SELECT {K}, count(*) AS window_count, sum(usable_window)::BIGINT AS usable_window_count,
  round(avg(gaze_valid_ratio) + 3e-9, 7) AS mean_valid_ratio, round(avg(idt_fixation_count) + 3e-9, 7) AS mean_idt_fixation_count,
  round(avg(ivt_fixation_count) + 3e-9, 7) AS mean_ivt_fixation_count, round(avg(rapid_shift_count) + 3e-9, 7) AS mean_rapid_shift_count
FROM ({FULL_SQL.replace('round(valid_samples / total_samples + 3e-9, 7)', 'valid_samples / total_samples')}) GROUP BY {K}""")
def _(x):
    return features.gaze_stream_summary(gaze_windows(x), tuple(KEYS), digits=None)


@query("select_gaze_for_normal", sql(f"""SELECT {K}, frame, NULL::BIGINT AS missing_frames, NULL::BIGINT AS first_missing_frame
FROM gz WHERE ({K}, frame) IN (SELECT {K}, frame FROM wanted) AND ({K}) NOT IN (SELECT {K} FROM absent)
UNION ALL SELECT {K}, NULL, count(*), min(frame) FROM absent GROUP BY {K}""", "slid", "normal_w", extra={
    "wanted": f"SELECT DISTINCT {K}, frame FROM slid JOIN normal_w USING ({K}, window_index)",
    "gz": "SELECT * FROM frames WHERE event_id % 97 <> 0",
    "absent": f"SELECT {K}, frame FROM wanted WHERE ({K}, frame) NOT IN (SELECT {K}, frame FROM gz)"}))
def _(x):
    """Gaze rows lack every 97th event, so some series miss normal frames."""
    f, s = x.frames(), x.series()
    wide = stage(windows.sliding_count_windows(clean_normal_source(f, s), WINDOW, 5, s).select(
        *KEYS, "frame", "window_index", "time_sec", "avg_ear", "yaw", "pitch"))
    normal = wide.join(rules.normal_window_table(wide, s).select(*KEYS, "window_index"), [*KEYS, "window_index"], "left_semi")
    good, errors = gaze.select_gaze_for_normal(f.filter("event_id % 97 <> 0"), normal, s)
    return good.select(*KEYS, "frame").unionByName(
        errors.select(*KEYS, "missing_frames", F.col("first_missing_frame").cast("long")), allowMissingColumns=True)


# --- matching ------------------------------------------------------------------------------------------------

TOL = 0.1
UID = "substr(file_stem, 7)::BIGINT"
CTE["profile"] = (f"""SELECT {K}, max(time_sec) AS duration, count(*) AS rows, {UID} AS uid FROM frames GROUP BY {K}""", ("frames",))
GAZE_NAME = "'g' || chr((65 + uid % 26)::INT) || '_' || uid || '_s' || uid % 7 || CASE WHEN uid % 5 = 0 THEN '_panel' ELSE '' END"
CTE["src"] = ("SELECT label, modality, file_stem AS source, duration, rows, uid FROM profile WHERE (uid // 6) % 2 = 0", ("profile",))
CTE["par"] = (f"SELECT label, modality, {GAZE_NAME} AS partner, duration, rows, uid FROM profile WHERE (uid // 6) % 2 = 1", ("profile",))
CTE["cand"] = (f"""SELECT s.label, s.modality, source, s.uid AS suid, partner,
  round(abs(s.duration - p.duration), 6) AS dd, abs(s.rows - p.rows) AS rd,
  row_number() OVER (PARTITION BY source ORDER BY round(abs(s.duration - p.duration), 6), abs(s.rows - p.rows),
    65 + p.uid % 26, p.uid, p.uid % 7, p.uid % 5 = 0, partner) AS position
FROM src s JOIN par p ON s.label = p.label AND s.modality = p.modality AND abs(s.duration - p.duration) <= {TOL}""", ("src", "par"))


def sides(x: Inputs):
    profile = matching.series_profile(x.frames(), tuple(KEYS)).withColumn(
        "uid", F.substring("file_stem", 7, 20).cast("long"))
    half = F.floor(F.col("uid") / 6) % 2
    u = F.col("uid")
    name = F.concat(F.lit("g"), F.char((65 + u % 26).cast("int")), F.lit("_"), u.cast("string"), F.lit("_s"),
                    (u % 7).cast("string"), F.when(u % 5 == 0, "_panel").otherwise(""))
    sources = profile.filter(half == 0).select("label", "modality", F.col("file_stem").alias("source"), "duration", "rows")
    partners = profile.filter(half == 1).select("label", "modality", name.alias("partner"), "duration", "rows")
    return sources, partners


@query("match_candidates", sql(f"""SELECT label, modality, source, candidates, best_partner,
  round(best_duration_diff + 3e-9, 7) AS best_duration_diff, best_row_diff FROM (
SELECT s.label, s.modality, s.source, count(partner) AS candidates, any_value(partner) FILTER (position = 1) AS best_partner,
  any_value(dd) FILTER (position = 1) AS best_duration_diff, any_value(rd) FILTER (position = 1) AS best_row_diff
FROM src s LEFT JOIN cand c ON s.source = c.source GROUP BY ALL)""", "cand"))
def _(x):
    """Candidate count and best candidate per source, without a table of pairs."""
    return matching.match_summary(*sides(x), TOL).drop("duration", "rows")


@query("candidate_lists", sql("""SELECT s.label, s.modality, s.source, c.position, c.partner, round(c.dd + 3e-9, 7) AS duration_diff, c.rd AS row_diff
FROM src s JOIN cand c ON s.source = c.source""", "cand"))
def _(x):
    """Every candidate of every source in its order; the lists are kept once per profile."""
    sources, partners = sides(x)
    listed = matching.match_candidates(sources, partners, TOL)
    return sources.join(listed, ["label", "modality", "duration", "rows"]).drop("duration", "rows")


@query("name_keys", sql("""SELECT file_stem, uid AS natural_number, partner, (65 + uid % 26)::BIGINT AS letter, uid AS number, uid % 7 AS session,
  CASE WHEN uid % 5 = 0 THEN 1 ELSE 0 END AS panel FROM (SELECT *, """ + GAZE_NAME + """ AS partner FROM profile)""", "profile"))
def _(x):
    u = F.substring("file_stem", 7, 20).cast("long")
    name = F.concat(F.lit("g"), F.char((65 + u % 26).cast("int")), F.lit("_"), u.cast("string"), F.lit("_s"),
                    (u % 7).cast("string"), F.when(u % 5 == 0, "_panel").otherwise(""))
    streams = x.frames().select("file_stem").distinct().withColumn("partner", name)
    keyed = streams.withColumns({"n": matching.natural_key(F.col("file_stem")), "g": matching.gaze_name_key(F.col("partner"))})
    return keyed.select("file_stem", F.col("n.number").alias("natural_number"), "partner", "g.letter", "g.number",
                        "g.session", "g.panel")


GREEDY = {
    "turns": """SELECT s.label, s.modality, s.source, s.uid, coalesce(n, 0) AS n, best, dd, rd,
  row_number() OVER (PARTITION BY s.label, s.modality ORDER BY coalesce(n, 0), dd, rd, bl, bu, bs, bp, best, s.uid, s.source) AS turn
FROM src s LEFT JOIN (SELECT c.source, count(*) AS n, min(dd) FILTER (position = 1) AS dd, min(rd) FILTER (position = 1) AS rd,
  any_value(c.partner) FILTER (position = 1) AS best, any_value(65 + p.uid % 26) FILTER (position = 1) AS bl,
  any_value(p.uid) FILTER (position = 1) AS bu, any_value(p.uid % 7) FILTER (position = 1) AS bs,
  any_value(p.uid % 5 = 0) FILTER (position = 1) AS bp
  FROM cand c JOIN par p USING (label, modality, partner) GROUP BY c.source) b ON b.source = s.source""",
    "lists": """SELECT t.*, coalesce(l, []) AS choices FROM turns t LEFT JOIN
  (SELECT source, list(partner ORDER BY position) AS l FROM cand GROUP BY source) c USING (source)""",
    "walk": """SELECT label, modality, 0::BIGINT AS turn, NULL::VARCHAR AS source, NULL::VARCHAR AS partner, []::VARCHAR[] AS taken
FROM (SELECT DISTINCT label, modality FROM src)
UNION ALL SELECT label, modality, turn, source, partner, CASE WHEN partner IS NULL THEN taken ELSE list_append(taken, partner) END
FROM (SELECT w.label, w.modality, l.turn, l.source, w.taken,
    list_filter(l.choices, lambda c: NOT list_contains(w.taken, c))[1] AS partner
  FROM walk w JOIN lists l ON l.label = w.label AND l.modality = w.modality AND l.turn = w.turn + 1)""",
}


@query("greedy_match", sql("""SELECT w.label, w.modality, w.source, partner, n AS candidates, best AS best_partner,
  CASE WHEN n = 0 THEN 'no candidate' WHEN partner IS NULL THEN 'all taken' ELSE 'matched' END AS status
FROM walk w JOIN turns t ON t.source = w.source""", "cand", extra=GREEDY, recursive=True))
def _(x):
    sources, partners = sides(x)
    return matching.greedy_assign(sources, partners, TOL)


CTE["gz_side"] = (f"SELECT {K}, window_id, avg(iris_x_norm) AS x, count(*) AS samples FROM tw GROUP BY {K}, window_id", ("tw",))
CTE["gz_dup"] = (f"""SELECT * FROM gz_side WHERE (window_id + {UID}) % 4 <> 0
UNION ALL SELECT * FROM gz_side WHERE {UID} % 11 = 0 AND window_id = 2""", ("gz_side",))


def merge_sides(x: Inputs):
    """Baseline windows and a gaze side with holes and, in some series, a repeated window."""
    f, s = x.frames(), x.series()
    uid = F.substring("file_stem", 7, 20).cast("long")
    right = windows.time_windows(f, SIZE_S, SIZE_S, s).groupBy(*KEYS, "window_id").agg(
        F.avg("iris_x_norm").alias("x"), F.count(F.lit(1)).alias("samples"))
    holes = right.filter((F.col("window_id") + uid) % 4 != 0)
    twice = right.filter((uid % 11 == 0) & (F.col("window_id") == 2))
    return window_table(x).select(*KEYS, "window_id", "is_usable"), holes.unionByName(twice)


JOINED = {"dup": f"SELECT DISTINCT {K} FROM (SELECT {K}, window_id FROM gz_dup GROUP BY {K}, window_id HAVING count(*) > 1)"}


@query("one_to_one_join", sql(f"""SELECT {K}, window_id, w.is_usable, round(x + 3e-9, 7) AS gaze_x, samples AS gaze_samples,
  samples IS NOT NULL AS matched FROM wf w LEFT JOIN gz_dup g USING ({K}, window_id)
WHERE ({K}) NOT IN (SELECT {K} FROM dup)""", "wf", "gz_dup", extra=JOINED))
def _(x):
    left, right = merge_sides(x)
    return matching.one_to_one_left_join(left, right, tuple(KEYS))[0]


@query("one_to_one_errors", sql(f"""SELECT {K}, count(*) AS repeated_keys, 'right' AS side FROM
  (SELECT {K}, window_id FROM gz_dup GROUP BY {K}, window_id HAVING count(*) > 1) GROUP BY {K}""", "gz_dup"))
def _(x):
    left, right = merge_sides(x)
    return matching.one_to_one_left_join(left, right, tuple(KEYS))[1]


@query("merge_report", sql(f"""SELECT {K}, b AS baseline_rows, coalesce(g, 0) AS gaze_rows, coalesce(m, 0)::BIGINT AS matched_rows,
  (b - coalesce(m, 0))::BIGINT AS missing_rows, CASE WHEN b = coalesce(m, 0) THEN 'ok' ELSE 'partial' END AS status
FROM (SELECT {K}, count(*) AS b FROM wf GROUP BY {K})
LEFT JOIN (SELECT {K}, count(*) AS g FROM gz_dup GROUP BY {K}) USING ({K})
LEFT JOIN (SELECT {K}, count(*) FILTER (samples IS NOT NULL) AS m FROM wf w LEFT JOIN gz_dup USING ({K}, window_id)
  WHERE ({K}) NOT IN (SELECT {K} FROM dup) GROUP BY {K}) USING ({K})""", "wf", "gz_dup", extra=JOINED))
def _(x):
    left, right = merge_sides(x)
    left, right = stage(left), stage(right)
    merged, _ = matching.one_to_one_left_join(left, right, tuple(KEYS))
    return matching.merge_report(left, right, merged, tuple(KEYS))


@query("resolve_partner", sql("""SELECT label, modality, source, partner,
  CASE WHEN partner IS NULL OR puid % 5 = 4 THEN NULL WHEN puid % 2 = 0 THEN 'main/' || partner ELSE 'spare/' || partner END AS location,
  CASE WHEN partner IS NULL THEN 'no matched partner' WHEN puid % 5 = 4 THEN 'partner windows not found' END AS error
FROM (SELECT s.label, s.modality, s.source, b.partner, b.puid FROM src s LEFT JOIN
  (SELECT source, partner, regexp_extract(partner, '_(\\d+)_', 1)::BIGINT AS puid FROM cand WHERE position = 1) b USING (source))""", "cand"))
def _(x):
    """The best candidate plays the matched partner; its windows lie in one of two locations or nowhere."""
    sources, partners = sides(x)
    listed = matching.match_candidates(sources, partners, TOL)
    mapping = matching.candidate_summary(sources, listed).select(
        "label", "modality", "source", F.col("best_partner").alias("partner")).withColumn(
        "status", F.when(F.col("partner").isNull(), "no candidate").otherwise("matched"))
    uid = F.regexp_extract("partner", r"_(\d+)_", 1).cast("long")
    here = partners.select("label", "modality", "partner").filter(uid % 5 != 4)
    main = here.filter(uid % 2 == 0).withColumn("location", F.concat(F.lit("main/"), "partner"))
    spare = here.withColumn("location", F.concat(F.lit("spare/"), "partner"))
    found, errors = matching.resolve_partner(sources.select("label", "modality", "source"), mapping, main, spare)
    named = errors.join(mapping.select("label", "modality", "source", "partner"), ["label", "modality", "source"])
    return found.select("label", "modality", "source", "partner", "location").unionByName(
        named, allowMissingColumns=True)
