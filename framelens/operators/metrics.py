"""Classification metrics and model rankings.

Every metric starts from one conditional aggregate over the predictions, whose result has one cell per pair of
labels; zero cells are present and no join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framelens.config import LABELS
from framelens.operators.clean import align_union

METRICS = ("accuracy", "macro_f1", "weighted_f1")


def _cells(labels: tuple[str, ...]) -> list[Column]:
    hit = lambda t, p: F.when((F.col("label") == t) & (F.col("predicted_label") == p), 1)
    return [F.count(hit(t, p)).alias(f"_{i}_{j}") for i, t in enumerate(labels) for j, p in enumerate(labels)]


def _add(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def _per_class(labels: tuple[str, ...]) -> list[dict[str, Column]]:
    """True positives, support, predictions and scores per class; undefined scores are zero."""
    n = range(len(labels))
    ratio = lambda a, b: F.when(b > 0, a / b.cast("double")).otherwise(F.lit(0.0))
    out = []
    for i in n:
        tp, support = F.col(f"_{i}_{i}"), _add([F.col(f"_{i}_{j}") for j in n])
        predicted = _add([F.col(f"_{j}_{i}") for j in n])
        out.append({"tp": tp, "support": support, "predicted": predicted, "precision": ratio(tp, predicted),
                    "recall": ratio(tp, support), "f1": ratio(tp * 2, support + predicted)})
    return out


def _averages(classes: list[dict[str, Column]]) -> dict[str, dict[str, Column]]:
    total = _add([c["support"] for c in classes])
    seen = [F.when(c["support"] + c["predicted"] > 0, 1.0).otherwise(0.0) for c in classes]
    macro = lambda k: F.when(_add(seen) > 0, _add([c[k] * s for c, s in zip(classes, seen)]) / _add(seen)).otherwise(0.0)
    weighted = lambda k: F.when(total > 0, _add([c[k] * c["support"] for c in classes]) / total.cast("double")).otherwise(0.0)
    keys = ("precision", "recall", "f1")
    accuracy = F.when(total > 0, _add([c["tp"] for c in classes]) / total.cast("double")).otherwise(0.0)
    return {"macro avg": {k: macro(k) for k in keys}, "weighted avg": {k: weighted(k) for k in keys},
            "accuracy": {k: accuracy for k in keys}}


def confusion_matrix(predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per true label in fixed order, one column per predicted label."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f"true_{t}").alias("true_label"),
                              *[F.col(f"_{i}_{j}").alias(f"pred_{p}") for j, p in enumerate(labels)])
                     for i, t in enumerate(labels)])
    return predictions.agg(*_cells(labels)).select(F.inline(rows))


def classification_report(predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    classes = _per_class(labels)
    total = _add([c["support"] for c in classes])
    row = lambda name, s, support: F.struct(F.lit(name).alias("name"), s["precision"].alias("precision"),
                                            s["recall"].alias("recall"), s["f1"].alias("f1"), support.alias("support"))
    rows = [row(name, c, c["support"]) for name, c in zip(labels, classes)]
    rows += [row(name, s, total) for name, s in _averages(classes).items()]
    return predictions.agg(*_cells(labels)).select(F.inline(F.array(*rows)))


def metrics_row(predictions: DataFrame, train: DataFrame, labels: tuple[str, ...] = LABELS, **info) -> DataFrame:
    """Scores at six decimals with the sizes of both sides, from one aggregate over the tagged rows."""
    tagged = predictions.select("label", "predicted_label", "group_id", F.lit("test").alias("side")).unionByName(
        train.select(F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("predicted_label"),
                     "group_id", F.lit("train").alias("side")))
    on = lambda side, value: F.when(F.col("side") == side, value)
    one = tagged.agg(
        *_cells(labels), F.count(on("train", 1)).alias("train_rows"), F.count(on("test", 1)).alias("test_rows"),
        F.countDistinct(on("train", F.col("group_id"))).alias("train_groups"),
        F.countDistinct(on("test", F.col("group_id"))).alias("test_groups"))
    avg = _averages(_per_class(labels))
    return one.select(
        *[F.lit(v).alias(k) for k, v in info.items()],
        F.bround(avg["accuracy"]["f1"], 6).alias("accuracy"), F.bround(avg["macro avg"]["f1"], 6).alias("macro_f1"),
        F.bround(avg["weighted avg"]["f1"], 6).alias("weighted_f1"),
        "train_rows", "test_rows", "train_groups", "test_groups")


def verify_accuracy(predictions: DataFrame, reported: float | None = None,
                    labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Accuracy from the confusion matrix and from the rows, with their distance to the reported value."""
    same = F.count(F.when(F.col("label") == F.col("predicted_label"), 1))
    one = predictions.agg(*_cells(labels), same.alias("_same"), F.count(F.lit(1)).alias("_all"))
    cells = [F.col(f"_{i}_{j}") for i in range(len(labels)) for j in range(len(labels))]
    diag = [F.col(f"_{i}_{i}") for i in range(len(labels))]
    row = lambda name, ok, n: F.struct(F.lit(name).alias("method"), ok.alias("correct"), n.alias("total"))
    table = one.select(F.inline(F.array(row("confusion_matrix", _add(diag), _add(cells)),
                                        row("test_predictions", F.col("_same"), F.col("_all")))))
    table = table.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total").cast("double"))
                             .otherwise(F.lit(0.0)))
    return table.withColumn("difference", F.abs(F.col("accuracy") - F.lit(reported).cast("double")))


def rank_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(*[F.col(m).desc() for m in METRICS], "model_key")


def master_summary(summaries: dict[str, DataFrame | None]) -> DataFrame:
    """Union of the scenario summaries that exist, by scenario and then best first."""
    tables = [df.withColumn("scenario", F.lit(name)) for name, df in summaries.items() if df is not None]
    if not tables:
        raise ValueError("no scenario summary to combine")
    return align_union(tables).orderBy("scenario", *[F.col(m).desc() for m in METRICS])


def pivot_accuracy(metrics: DataFrame, scenarios: list[str]) -> DataFrame:
    """Accuracy per model and scenario, and the best F1 values over the scenarios, each on its own."""
    at = lambda s: F.max(F.when(F.col("scenario") == s, F.col("accuracy"))).alias(s)
    return metrics.groupBy("model_label").agg(
        *[at(s) for s in scenarios], F.max("macro_f1").alias("best_macro_f1"),
        F.max("weighted_f1").alias("best_weighted_f1"))


def rank_table(metrics: DataFrame, scenario: str) -> DataFrame:
    """Positions 1..n of the models of one scenario; one row per model, so one small ordered list."""
    order = F.struct(*[(-F.col(m)).alias(m) for m in METRICS], F.col("model_label").alias("model_label"),
                     F.col("model_key").alias("model_key"))
    rows = metrics.filter(F.col("scenario") == scenario).agg(F.array_sort(F.collect_list(order)).alias("_rows"))
    ranked = rows.select(F.posexplode("_rows").alias("_at", "_row"))
    return ranked.select((F.col("_at") + 1).cast("long").alias("rank"), "_row.model_label",
                         *[(-F.col(f"_row.{m}")).alias(m) for m in METRICS])
