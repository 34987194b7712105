"""Queries that fit models on the derived windows, and nearest neighbours on stored vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelens.config import LABELS, SCENARIOS
from framelens.operators import knn
from framelens.operators.metrics import METRICS, metrics_row
from framelens.operators.models import REGISTRY, feature_importance, load_bundle, train_model
from framelens.operators.rules import feature_columns
from framelens.operators.scoring import PROBABILITIES
from framelens.operators.series import stage, stage_folder
from framelens.operators.split import group_split
from framelens.plans import model_queries  # noqa: F401  its building blocks hold the split
from framelens.plans.gaze_queries import CFG as GAZE_CFG
from framelens.plans.registry import K, Inputs, query, sql
from framelens.plans.scoring_chain import predict_windows, score_streams, scoring_windows
from framelens.plans.training import compare_models, scenario_grid, training_rows
from framelens.plans.window_queries import CFG, KEYS, window_table

FEATURES = feature_columns("baseline")


def split_sides(x: Inputs):
    train, test = group_split(stage(training_rows(window_table(x), "baseline", False)))
    return stage(train), stage(test)


# A fitted model is compared by what holds for any right fit: the sides it was given, and that it beats the majority label.
SIDES = ", ".join(f"count({what}) FILTER (fold {op} 0) AS {side}_{name}" for what, name in (("*", "rows"), ("DISTINCT group_id", "groups"))
                  for side, op in (("train", "<>"), ("test", "=")))


def sides_sql(rows: str = "train") -> str:
    return f"SELECT {SIDES} FROM {rows} JOIN folds USING (group_id)"


def _register(key: str) -> None:
    @query(f"train_{key}", sql(f"SELECT '{key}' AS model_key, *, true AS above_majority FROM ({sides_sql()})", "train", "folds"))
    def _(x):
        train, test = split_sides(x)
        row = metrics_row(train_model(key, train, FEATURES).predict(test), train, model_key=key)
        top = test.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
        return row.select("model_key", "train_rows", "test_rows", "train_groups", "test_groups",
                          (F.col("accuracy") > F.lit(top)).alias("above_majority"))


for _key in REGISTRY:
    _register(_key)


def forest(x: Inputs):
    train, test = split_sides(x)
    return train_model("random_forest", train, FEATURES), train, test


@query("feature_importance", "SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, true AS not_negative, true AS adds_up")
def _(x):
    fit, _, _ = forest(x)
    table = feature_importance(x.spark, fit)
    total = table.agg(F.sum("importance")).first()[0]
    return table.select("feature", (F.col("importance") >= 0).alias("not_negative"), F.lit(abs(total - 1.0) < 1e-6).alias("adds_up"))


@query("predict_windows", sql(f"SELECT {K}, window_id, true AS adds_up, true AS likeliest, true AS risk_follows FROM train", "train"))
def _(x):
    fit, _, _ = forest(x)
    own = F.coalesce(*[F.when(F.col("predicted_label") == n, F.col(f"prob_{n}")) for n in LABELS])
    return predict_windows(window_table(x), fit).select(
        *KEYS, "window_id", (F.abs(sum((F.col(p) for p in PROBABILITIES), F.lit(-1.0))) < 1e-9).alias("adds_up"),
        (own == F.greatest(*PROBABILITIES)).alias("likeliest"),
        (F.abs(F.col("window_risk_score") - 100.0 * (1.0 - F.col("prob_normal"))) <= 0.0501).alias("risk_follows"))


@query("score_streams", sql(f"""SELECT {K}, CASE WHEN t.n IS NULL THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN w.n IS NULL THEN 'no full window' WHEN t.n IS NULL THEN 'no usable window' ELSE '' END AS message,
  t.n AS usable_window_count, f.n AS total_frames, round(f.d + 3e-9, 7) AS detected_face_ratio, t.n IS NOT NULL AS has_verdict
FROM (SELECT {K}, count(*) AS n, avg(CASE WHEN face_detected = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS d FROM frames GROUP BY {K}) f
LEFT JOIN (SELECT {K}, count(*) AS n FROM wf GROUP BY {K}) w USING ({K})
LEFT JOIN (SELECT {K}, count(*) AS n FROM train GROUP BY {K}) t USING ({K})""", "frames", "wf", "train"))
def _(x):
    fit, _, _ = forest(x)
    _, verdicts = score_streams(x.frames(), x.series(), fit, cfg=CFG)
    sound = F.col("overall_label").isin(*LABELS) & F.col("overall_confidence").between(0.0, 1.0) & F.col("risk_score").between(0.0, 100.0)
    return verdicts.select(*KEYS, "status", "message", "usable_window_count", "total_frames", "detected_face_ratio",
                           F.coalesce(sound, F.lit(False)).alias("has_verdict"))


@query("saved_model", sql(f"SELECT {K}, window_id, true AS same FROM train", "train"))
def _(x):
    """A model that was saved and loaded predicts what the fitted one does."""
    train, _ = split_sides(x)
    fit = train_model("logistic_regression", train, FEATURES)
    path = f"{stage_folder(x.spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    fit.save(x.spark, path, {"feature_set": "baseline"})
    again, _ = load_bundle(x.spark, path)
    keys = [*KEYS, "window_id"]
    own = predict_windows(window_table(x), fit).select(*keys, F.col("prob_normal").alias("_a"))
    other = predict_windows(window_table(x), again).select(*keys, F.col("prob_normal").alias("_b"))
    return own.join(other, keys).select(*keys, (F.abs(F.col("_a") - F.col("_b")) < 1e-12).alias("same"))


@query("compare_models", sql(f"""SELECT unnest([{", ".join(f"'{k}'" for k in REGISTRY)}]) AS model_key, *, true AS in_range
FROM ({sides_sql()})""", "train", "folds"))
def _(x):
    table, _ = compare_models(window_table(x))
    scores = F.least(*METRICS).between(0.0, 1.0) & F.greatest(*METRICS).between(0.0, 1.0)
    return table.select("model_key", "train_rows", "train_groups", "test_rows", "test_groups", scores.alias("in_range"))


@query("scenario_grid", "SELECT unnest([" + ", ".join(f"'{n}'" for n, _, _ in SCENARIOS) + "]) AS scenario, "
       + f"{len(REGISTRY)}::BIGINT AS models, true AS all_rows_used, true AS in_range")
def _(x):
    base = stage(window_table(x))
    gaze = stage(scoring_windows(x.frames(), x.series(), CFG, x.frames(), GAZE_CFG))
    table = stage(scenario_grid({"baseline": base, "gaze": gaze}))
    sizes = {name: training_rows(base if features == "baseline" else gaze, features, strict).count() for name, features, strict in SCENARIOS}
    used = F.coalesce(*[F.when(F.col("scenario") == n, F.col("train_rows") + F.col("test_rows") == F.lit(c)) for n, c in sizes.items()])
    scores = F.least(*METRICS).between(0.0, 1.0) & F.greatest(*METRICS).between(0.0, 1.0)
    return table.groupBy("scenario").agg(F.countDistinct("model_key").alias("models"), F.bool_and(used).alias("all_rows_used"),
                                         F.bool_and(scores).alias("in_range"))


DIST = "list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[])"
NEAR_SQL = f"""SELECT query_id, train_id, d, rank, label FROM (SELECT q.vec_id AS query_id, t.vec_id AS train_id, t.label, {DIST} AS d,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, t.vec_id) AS rank
FROM embeddings q JOIN embeddings t ON q.vec_id % 4 = 0 AND t.vec_id % 4 <> 0) WHERE rank <= 7"""


def vectors(x: Inputs):
    """Every fourth vector asks, the others are searched."""
    v = x.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    return v.filter("id % 4 = 0"), v.filter("id % 4 <> 0")


@query("nearest_neighbours", f"SELECT query_id, train_id, round(d + 3e-9, 7) AS distance, rank::INT AS rank FROM ({NEAR_SQL})")
def _(x):
    asks, base = vectors(x)
    return knn.nearest_neighbours(asks, base, 7)


@query("knn_classify", f"""SELECT query_id, arg_min(label, (-w, label)) AS predicted_label FROM (
SELECT query_id, label, sum(CASE WHEN m = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / d END) AS w
FROM (SELECT *, min(d) OVER (PARTITION BY query_id) AS m FROM ({NEAR_SQL})) GROUP BY query_id, label) GROUP BY query_id""")
def _(x):
    asks, base = vectors(x)
    near = stage(knn.nearest_neighbours(asks, base, 7))
    return knn.classify(near, base.select(F.col("id").alias("train_id"), "label"))
