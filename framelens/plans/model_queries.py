"""Queries over splits, metrics, rankings and scoring."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from framelens.config import LABELS
from framelens.operators import features, metrics, rules, scoring, split
from framelens.operators.series import stage, stage_folder
from framelens.plans.registry import CTE, RECURSIVE, K, Inputs, query, shown, sql
from framelens.sources import run_store
from framelens.plans.window_queries import HC_SQL, KEYS, window_table

GROUP = "modality || '::' || file_stem"
COMPLETE = " AND ".join(c + " IS NOT NULL" for c in rules.feature_columns("baseline"))
CTE["train"] = (f"SELECT *, {GROUP} AS group_id FROM wf WHERE is_usable = 1 AND {COMPLETE}", ("wf",))


def training(x: Inputs):
    return rules.training_filter(split.with_group_id(window_table(x)))


def rule_label(seed: int):
    """A stand-in prediction: every fifth window gets the next label."""
    label = F.col("label")
    turn = F.when(label == "normal", "drowsiness").when(label == "drowsiness", "distraction").otherwise("normal")
    return F.when((F.col("window_id") + F.col("window_start_frame") + seed) % 5 == 0, turn).otherwise(label)


def predicted_sql(seed: int, source: str = "train") -> str:
    return f"""SELECT *, CASE WHEN (window_id + window_start_frame + {seed}) % 5 = 0 THEN CASE label WHEN 'normal' THEN 'drowsiness'
  WHEN 'drowsiness' THEN 'distraction' ELSE 'normal' END ELSE label END AS predicted_label FROM {source}"""


CTE["pred"] = (predicted_sql(0), ("train",))


def predicted(x: Inputs, seed: int = 0):
    return training(x).withColumn("predicted_label", rule_label(seed))


@query("group_id", sql(f"SELECT {K}, window_id, {GROUP} AS group_id FROM wf", "wf"))
def _(x):
    return split.with_group_id(window_table(x)).select(*KEYS, "window_id", "group_id")


HASH = "('0x' || substr(md5('42:' || group_id), 1, 15))::BIGINT"
CLASSES = sorted(LABELS)
CTE["grp"] = ("SELECT group_id, string_agg(DISTINCT label, '+' ORDER BY label) AS stratum, count(*) AS rows, "
              + ", ".join(f"count(*) FILTER (label = '{c}') AS g{i}" for i, c in enumerate(CLASSES)) + " FROM train GROUP BY group_id", ("train",))
_G = ", ".join(f"g{i}" for i in range(len(CLASSES)))
CTE["dealt"] = (f"""SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY {HASH}) - 1 AS p, count(*) OVER (PARTITION BY {_G}) AS n FROM grp""", ("grp",))
CTE["units"] = (f"""SELECT *, row_number() OVER (ORDER BY rows DESC, {_G.replace(",", " DESC,")} DESC, p) AS u FROM dealt WHERE p >= n // 5 * 5""", ("dealt",))
CTE["whole"] = ("SELECT " + ", ".join(f"sum(g{i})::DOUBLE AS n{i}" for i in range(len(CLASSES))) + " FROM grp", ("grp",))
_HELD = [f"h{i}" for i in range(len(CLASSES))]
CTE["fold_walk"] = (RECURSIVE + f"""SELECT 0::BIGINT AS u, 0 AS f, {", ".join(f"[0, 0, 0, 0, 0]::BIGINT[] AS {h}" for h in _HELD)}
UNION ALL SELECT u, f, {", ".join(f"list_transform([1, 2, 3, 4, 5], lambda i: {h}[i] + CASE WHEN i = f THEN g{j} ELSE 0 END) AS {h}" for j, h in enumerate(_HELD))}
FROM (SELECT x.u, {_G}, {", ".join(_HELD)}, list_min(list_transform([1, 2, 3, 4, 5], lambda i: struct_pack(
    s := {" + ".join(f"{h}[i] * g{j} / (n{j} * n{j})" for j, h in enumerate(_HELD))}, t := {" + ".join(f"{h}[i]" for h in _HELD)}, f := i))).f AS f
  FROM fold_walk w JOIN units x ON x.u = w.u + 1 CROSS JOIN whole)""", ("units", "whole"))
CTE["folds"] = ("""SELECT d.group_id, d.stratum, d.rows, CASE WHEN d.p < d.n // 5 * 5 THEN d.p % 5 ELSE w.f - 1 END::INT AS fold
FROM dealt d LEFT JOIN units x ON x.group_id = d.group_id LEFT JOIN fold_walk w ON w.u = x.u""", ("dealt", "fold_walk"))


@query("stratified_group_split", sql("SELECT group_id, stratum, rows, fold FROM folds", "folds"))
def _(x):
    return split.stratified_group_folds(training(x), 5).drop("labels")


@query("class_shares", sql(f"""SELECT label, 5::BIGINT AS folds, true AS even FROM train GROUP BY label""", "train"))
def _(x):
    """No fold's share of a label is further from a fifth than the largest group of it: a bound on any such dealing."""
    rows = stage(training(x))
    folds = rows.join(split.stratified_group_folds(rows, 5).select("group_id", "fold"), "group_id")
    per = folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))
    most = rows.groupBy("label", "group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    even = F.max(F.abs(F.col("n") - F.col("all") / 5) - F.col("most")) <= 0
    return per.join(most, "label").groupBy("label").agg(F.count(F.lit(1)).alias("folds"), even.alias("even"))


@query("group_split", sql("""SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS side, label, count(*) AS rows,
  count(DISTINCT group_id) AS groups FROM train JOIN folds USING (group_id) GROUP BY ALL""", "train", "folds"))
def _(x):
    train, test = split.group_split(stage(training(x)))
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side", "label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("group_id").alias("groups"))


@query("group_split_rules", sql("""SELECT 0::BIGINT AS shared_groups, 0::BIGINT AS labels_on_one_side, true AS fair_share"""))
def _(x):
    """What any good split must satisfy, whatever the dealing: nothing of it is taken from the code."""
    train, test = split.group_split(stage(training(x)))
    both = stage(train.select("group_id", "label", F.lit(0).alias("t")).unionByName(test.select("group_id", "label", F.lit(1).alias("t"))))
    shared = both.groupBy("group_id").agg(F.countDistinct("t").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_groups"))
    labels = both.groupBy("label").agg(F.countDistinct("t").alias("n")).agg(F.count_if(F.col("n") < 2).alias("labels_on_one_side"))
    share = both.agg(F.avg("t").between(0.1, 0.35).alias("fair_share"))
    one = lambda df: df.withColumn("_", F.lit(1))
    return one(shared).join(one(labels), "_").join(one(share), "_").drop("_")


@query("fallback_group_split", sql(f"""SELECT DISTINCT group_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, group_id FROM train))
WHERE r <= least(greatest(1, round_even(n * 0.2, 0)), n - 1)""", "train"))
def _(x):
    return split.fallback_test_groups(training(x))


@query("class_weights", sql("""SELECT label, rows, round(sum(rows) OVER () / (count(*) OVER () * rows) + 3e-9, 7) AS weight
FROM (SELECT label, count(*) AS rows FROM train GROUP BY label)""", "train"))
def _(x):
    return split.class_weights(training(x))


@query("label_codec", sql("""SELECT label, code, label AS decoded, count(*) AS rows FROM (SELECT label,
  CASE label WHEN 'distraction' THEN 0 WHEN 'drowsiness' THEN 1 ELSE 2 END::DOUBLE AS code FROM train) GROUP BY label, code""", "train"))
def _(x):
    from framelens.operators.models import label_codec

    encode, decode = label_codec(training(x))
    coded = encode.transform(training(x))
    return decode.transform(coded).groupBy("label", F.col("label_code").alias("code"), "decoded").agg(
        F.count(F.lit(1)).alias("rows"))


CM = ", ".join(f"count(*) FILTER (predicted_label = '{p}') AS pred_{p}" for p in LABELS)


@query("confusion_matrix", sql(" UNION ALL ".join(
    f"SELECT {i} AS position, 'true_{t}' AS true_label, {CM} FROM pred WHERE label = '{t}'" for i, t in enumerate(LABELS)), "pred"))
def _(x):
    return metrics.confusion_matrix(predicted(x))


CTE["percls"] = (" UNION ALL ".join(f"""SELECT '{t}' AS name, count(*) FILTER (label = '{t}') AS support, count(*) FILTER (predicted_label = '{t}') AS predicted,
  count(*) FILTER (label = '{t}' AND predicted_label = '{t}') AS tp FROM pred""" for t in LABELS), ("pred",))
CTE["score"] = ("""SELECT name, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM percls""", ("percls",))
CTE["report"] = ("""SELECT name, precision, recall, f1, support FROM score
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM score
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM score
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::BIGINT FROM score""", ("score",))


@query("classification_report", sql(f"SELECT name, {shown('precision', 'recall', 'f1')}, support FROM report", "report"))
def _(x):
    return metrics.classification_report(predicted(x))


@query("metrics_row", sql("""SELECT 'rule' AS model_key, (SELECT round(f1, 6) FROM report WHERE name = 'accuracy') AS accuracy,
  (SELECT round(f1, 6) FROM report WHERE name = 'macro avg') AS macro_f1, (SELECT round(f1, 6) FROM report WHERE name = 'weighted avg') AS weighted_f1,
  (SELECT count(*) FROM train WHERE label <> 'normal') AS train_rows, (SELECT count(*) FROM train) AS test_rows,
  (SELECT count(DISTINCT group_id) FROM train WHERE label <> 'normal') AS train_groups, (SELECT count(DISTINCT group_id) FROM train) AS test_groups""", "report"))
def _(x):
    return metrics.metrics_row(predicted(x), training(x).filter("label <> 'normal'"), model_key="rule")


@query("verify_accuracy", sql("""SELECT method, correct, total, round(correct / total + 3e-9, 7) AS accuracy,
  round(abs(correct / total - 0.8) + 3e-9, 7) AS difference
FROM (SELECT unnest(['confusion_matrix', 'test_predictions']) AS method, count(*) FILTER (label = predicted_label) AS correct, count(*) AS total FROM pred)""", "pred"))
def _(x):
    return metrics.verify_accuracy(predicted(x), 0.8)


MODELS = {"model_a": ("Model A", 0), "model_b": ("Model B", 2), "model_c": ("Model C", 3)}
SCENES = {"baseline": 0, "high_confidence": 7}


def scenario_summaries(x: Inputs):
    """Scores of three stand-in models in two scenarios."""
    out, rows_all = {}, stage(training(x))
    for scene, shift in SCENES.items():
        base = rows_all
        base = rules.high_confidence_filter(base) if scene == "high_confidence" else base
        rows = [metrics.metrics_row(base.withColumn("predicted_label", rule_label(seed + shift)), base, model_key=key, model_label=label)
                for key, (label, seed) in MODELS.items()]
        out[scene] = metrics.align_union(rows)
    return out


HC = f"SELECT * FROM train WHERE {HC_SQL}"


def score_sql(scene: str, shift: int, key: str, label: str, seed: int) -> str:
    source = "hc" if scene == "high_confidence" else "train"
    c = lambda t: f"2 * count(*) FILTER (label = '{t}' AND predicted_label = '{t}') / (count(*) FILTER (label = '{t}') + count(*) FILTER (predicted_label = '{t}'))"
    macro = " + ".join(f"coalesce({c(t)}, 0)" for t in LABELS)
    seen = " + ".join(f"CASE WHEN count(*) FILTER (label = '{t}' OR predicted_label = '{t}') > 0 THEN 1 ELSE 0 END" for t in LABELS)
    weighted = " + ".join(f"coalesce({c(t)}, 0) * count(*) FILTER (label = '{t}')" for t in LABELS)
    return f"""SELECT '{scene}' AS scenario, '{key}' AS model_key, '{label}' AS model_label,
  round(count(*) FILTER (label = predicted_label) / count(*), 6) AS accuracy, round(({macro}) / ({seen}), 6) AS macro_f1,
  round(({weighted}) / count(*), 6) AS weighted_f1, count(*) AS rows FROM ({predicted_sql(seed + shift, source)})"""


CTE["hc"] = (HC, ("train",))
CTE["scores"] = (" UNION ALL ".join(score_sql(s, sh, k, lb, sd) for s, sh in SCENES.items() for k, (lb, sd) in MODELS.items()), ("hc",))


@query("master_summary", sql("SELECT scenario, model_key, model_label, accuracy, macro_f1, weighted_f1, rows AS test_rows FROM scores", "scores"))
def _(x):
    table = metrics.master_summary({**scenario_summaries(x), "gaze_baseline": None})
    return table.select("scenario", "model_key", "model_label", *metrics.METRICS, "test_rows")


def all_scores(x: Inputs):
    return metrics.align_union([df.withColumn("scenario", F.lit(s)) for s, df in scenario_summaries(x).items()])


@query("pivot_accuracy", sql("""SELECT model_label, max(accuracy) FILTER (scenario = 'baseline') AS baseline,
  max(accuracy) FILTER (scenario = 'high_confidence') AS high_confidence, max(macro_f1) AS best_macro_f1, max(weighted_f1) AS best_weighted_f1
FROM scores GROUP BY model_label""", "scores"))
def _(x):
    return metrics.pivot_accuracy(all_scores(x), list(SCENES))


@query("rank_table", sql("""SELECT row_number() OVER (ORDER BY accuracy DESC, macro_f1 DESC, weighted_f1 DESC, model_label) AS rank,
  model_label, accuracy, macro_f1, weighted_f1 FROM scores WHERE scenario = 'high_confidence'""", "scores"))
def _(x):
    return metrics.rank_table(all_scores(x), "high_confidence")


# --- scoring over rule-made probabilities ----------------------------------------------------------------------

CTE["prob"] = ("""SELECT *, CASE WHEN prob_normal >= prob_drowsiness AND prob_normal >= prob_distraction THEN 'normal'
  WHEN prob_drowsiness >= prob_distraction THEN 'drowsiness' ELSE 'distraction' END AS predicted_label,
  (prob_drowsiness + prob_distraction) * 100.0 AS risk
FROM (SELECT *, 1.0::DOUBLE - prob_drowsiness - prob_distraction AS prob_normal FROM (SELECT *,
  least(perclos, 1.0::DOUBLE) * 0.6::DOUBLE AS prob_drowsiness, least(mean_abs_yaw / 60.0::DOUBLE, 0.4::DOUBLE) AS prob_distraction FROM train))""", ("train",))


def scored(x: Inputs):
    """Windows with probabilities that a rule derives from eye closure and yaw."""
    d = F.least(F.col("perclos"), F.lit(1.0)) * F.lit(0.6)
    t = F.least(F.col("mean_abs_yaw") / F.lit(60.0), F.lit(0.4))
    base = training(x).withColumns({"prob_drowsiness": d, "prob_distraction": t})
    base = base.withColumn("prob_normal", F.lit(1.0) - F.col("prob_drowsiness") - F.col("prob_distraction"))
    chosen = scoring.first_maximum({n: F.col(f"prob_{n}") for n in LABELS})
    return scoring.window_risk(base.withColumn("predicted_label", chosen))


@query("window_risk", sql(f"SELECT {K}, window_id, predicted_label, {shown(*scoring.PROBABILITIES)}, round_even(risk, 1) AS window_risk_score FROM prob", "prob"))
def _(x):
    return scored(x).select(*KEYS, "window_id", "predicted_label", *scoring.PROBABILITIES, "window_risk_score")


CTE["verdict"] = (f"""SELECT {K}, avg(prob_normal) AS mn, avg(prob_drowsiness) AS md, avg(prob_distraction) AS mt, count(*) AS n,
  avg(greatest(prob_normal, prob_drowsiness, prob_distraction)) AS mw, count(*) FILTER (predicted_label = 'normal') AS cn,
  count(*) FILTER (predicted_label = 'drowsiness') AS cd, count(*) FILTER (predicted_label = 'distraction') AS ct,
  CASE WHEN avg(prob_normal) >= avg(prob_drowsiness) AND avg(prob_normal) >= avg(prob_distraction) THEN 'normal'
    WHEN avg(prob_drowsiness) >= avg(prob_distraction) THEN 'drowsiness' ELSE 'distraction' END AS overall_label FROM prob GROUP BY {K}""", ("prob",))


@query("stream_verdict", sql(f"""SELECT {K}, overall_label, n AS usable_window_count, cn AS count_normal, cd AS count_drowsiness, ct AS count_distraction,
  CASE overall_label WHEN 'normal' THEN cn WHEN 'drowsiness' THEN cd ELSE ct END AS dominant_window_count,
  round_even(CASE overall_label WHEN 'normal' THEN cn WHEN 'drowsiness' THEN cd ELSE ct END / n, 4) AS dominant_window_ratio FROM verdict""", "verdict"))
def _(x):
    table = scoring.stream_verdict(scored(x), tuple(KEYS))
    return table.select(*KEYS, "overall_label", "usable_window_count",
                        *[F.col("predicted_window_counts")[n].alias(f"count_{n}") for n in LABELS],
                        "dominant_window_count", "dominant_window_ratio")


CREATED = "2024-01-02 03:04:05"


RUN_SQL = f"""SELECT ('0x' || substr(md5(slug), 1, 15))::BIGINT AS id, slug AS analysis_slug, file_stem AS source_video_name,
  label || '/' || modality || '/' || file_stem AS source_video_path, label AS source_label, modality AS source_modality, 'rule' AS model_key,
  'baseline' AS feature_set, 1 AS fast_mode, overall_label, round_even(greatest(mn, md, mt), 4) AS overall_confidence,
  round_even((md + mt) * 100.0, 1) AS risk_score, total_frames, round(face + 3e-9, 7) AS detected_face_ratio, round(pose + 3e-9, 7) AS valid_pose_ratio,
  round(ear + 3e-9, 7) AS valid_ear_ratio, round(odd + 3e-9, 7) AS suspicious_ear_ratio, valid_frame_count, day, moment AS created_at,
  round_even(mn, 4) AS mean_normal, round_even(md, 4) AS mean_drowsiness, round_even(mt, 4) AS mean_distraction,
  label || '/' || modality || '/' || file_stem AS windows_artifact
FROM (SELECT *, label || '_' || modality || '_' || file_stem || '_' || strftime(moment::TIMESTAMP, '%Y%m%d_%H%M%S') AS slug FROM verdict JOIN
  (SELECT {K}, count(*) AS total_frames, count(*) FILTER (face_detected = 1 AND avg_ear IS NOT NULL) AS valid_frame_count,
    avg(CASE WHEN face_detected = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS face, avg(CASE WHEN pose_valid = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS pose,
    avg(CASE WHEN ear_valid = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS ear, avg(CASE WHEN ear_suspicious = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS odd
   FROM frames GROUP BY {K}) USING ({K})
  CROSS JOIN (SELECT unnest([2, 3]) AS day, unnest(['2024-01-02 03:04:05', '2024-01-03 03:04:05']) AS moment))"""
RUN_COLUMNS = ("id", "analysis_slug", "source_video_name", "source_video_path", "source_label", "source_modality", "model_key", "feature_set", "fast_mode",
               "overall_label", "overall_confidence", "risk_score", "total_frames", "detected_face_ratio", "valid_pose_ratio", "valid_ear_ratio",
               "suspicious_ear_ratio", "valid_frame_count")


def store(x: Inputs) -> str:
    """Runs stored at two moments, those of the first one twice."""
    path = f"{stage_folder(x.spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    place = x.spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(x.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    windows = stage(scored(x))
    verdicts, quality = scoring.stream_verdict(windows, tuple(KEYS)), features.quality_summary(x.frames(), tuple(KEYS))
    for day in (2, 3, 2):
        run_store.store_runs(path, verdicts, quality, windows, tuple(KEYS), model_key="rule", feature_set="baseline", created_at=datetime(2024, 1, day, 3, 4, 5))
    return path


def shown_runs(rows, *more: str):
    """Run rows with the time as text and the maps taken apart."""
    mean = F.from_json("mean_probabilities_json", "map<string,double>")
    return rows.select(*RUN_COLUMNS, F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                       *[F.element_at(mean, n).alias(f"mean_{n}") for n in LABELS],
                       F.element_at(F.from_json("artifacts_json", "map<string,string>"), "windows").alias("windows_artifact"), *more)


@query("append_run", sql(f"""SELECT {", ".join(RUN_COLUMNS)}, created_at, mean_normal, mean_drowsiness, mean_distraction, windows_artifact,
  '2024010' || day || '_030405' AS batch FROM ({RUN_SQL})""", "verdict", "frames"))
def _(x):
    """All columns of all stored runs, read back."""
    return shown_runs(run_store.stored(x.spark, store(x)), "batch")


@query("stored_windows", sql("""SELECT '2024010' || day || '_030405' AS batch, predicted_label, count(*) AS windows, count(DISTINCT file_stem) AS runs
FROM prob CROSS JOIN (SELECT unnest([2, 3]) AS day) GROUP BY ALL""", "prob"))
def _(x):
    """Window rows of the stored runs: a batch that is stored twice is there once."""
    return run_store.stored(x.spark, store(x), run_store.WINDOWS).groupBy("batch", "predicted_label").agg(
        F.count(F.lit(1)).alias("windows"), F.countDistinct("analysis_id").alias("runs"))


@query("append_predictions", sql(f"""SELECT ('0x' || substr(md5(slug || '#' || window_id), 1, 15))::BIGINT AS id, ('0x' || substr(md5(slug), 1, 15))::BIGINT AS analysis_id,
  window_id, predicted_label, is_usable, {shown('window_start_time', 'window_end_time', *scoring.PROBABILITIES, 'perclos_percent', 'mean_ear', 'max_abs_yaw')},
  round_even(risk, 1) AS window_risk_score FROM (SELECT *, label || '_' || modality || '_' || file_stem || '_20240102_030405' AS slug FROM prob)""", "prob"))
def _(x):
    return scoring.prediction_rows(scored(x), tuple(KEYS), created_at=F.to_timestamp(F.lit(CREATED)))


@query("recent_runs", sql(f"""SELECT id, created_at, source_video_name, source_label, source_modality, model_key, overall_label, overall_confidence, risk_score
FROM ({RUN_SQL}) ORDER BY created_at DESC, analysis_slug DESC LIMIT 5""", "verdict", "frames"))
def _(x):
    """The five latest of the stored runs."""
    return run_store.newest_runs(x.spark, store(x)).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("timeline", sql(f"SELECT {K}, window_id, predicted_label, {shown('window_start_time', 'window_end_time', *scoring.PROBABILITIES, 'perclos_percent', 'mean_ear', 'max_abs_yaw')}, round_even(risk, 1) AS window_risk_score FROM prob", "prob"))
def _(x):
    return scoring.timeline(scored(x), tuple(KEYS))


@query("timeline_summary", sql(f"""SELECT {K}, {shown('total_duration')}, windows, {', '.join(f"round(count_{n} / windows + 3e-9, 7) AS share_{n}" for n in LABELS)}
FROM (SELECT {K}, max(window_end_time) AS total_duration, count(*) AS windows, {', '.join(f"count(*) FILTER (predicted_label = '{n}') AS count_{n}" for n in LABELS)} FROM prob GROUP BY {K})""", "prob"))
def _(x):
    return scoring.timeline_summary(scored(x), tuple(KEYS))


@query("preset", sql(f"SELECT 'xgboost_baseline' AS model_key, {K}, count(*) AS frames FROM frames WHERE frame <= 900 GROUP BY {K}", "frames"))
def _(x):
    kept, model_key = scoring.clip(x.frames(), "quick")
    return kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("frames")).select(F.lit(model_key).alias("model_key"), *KEYS, "frames")
