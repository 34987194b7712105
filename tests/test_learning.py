"""Splits, metrics, models, neighbours and scoring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.config import LABELS
from framelens.operators import knn, metrics, models, scoring, split
from framelens.plans.training import compare_models, scenario_grid
from framelens.operators.rules import feature_columns
from tests.helpers import rows

# Small ensembles for tests of the plumbing; the queries run the registry's settings.
QUICK = {
    "random_forest": {"numTrees": 20, "maxDepth": 10}, "extra_trees": {"numTrees": 20, "maxDepth": 10},
    "gradient_boosting": {"rounds": 10}, "adaboost": {"rounds": 6}, "xgboost": {"rounds": 10, "depth": 4},
    "logistic_regression": {"maxIter": 100}, "linear_svm": {"maxIter": 30}, "rbf_svm": {"maxIter": 20, "width": 64},
    "decision_tree": {"maxDepth": 12},
}


def dataset(spark, groups=30):
    data = [(LABELS[g % 3], f"g{g}", w) for g in range(groups) for w in range(1 + g % 4)]
    data += [("normal", "g1", 99)]
    return spark.createDataFrame(data, "label string, group_id string, w int")


def test_split_never_shares_a_group_and_keeps_every_row(spark):
    df = dataset(spark)
    train, test = split.group_split(df)
    sides = [{r["group_id"] for r in side.collect()} for side in (train, test)]
    assert not sides[0] & sides[1] and train.count() + test.count() == df.count()
    assert {r["label"] for r in test.collect()} == set(LABELS)


def test_folds_are_balanced_and_equal_in_both_plans(spark):
    df = dataset(spark)
    folds = split.stratified_group_folds(df, 5)
    assert rows(folds.drop("labels")) == rows(split.stratified_group_folds(df, 5, limit=4).drop("labels"))
    per = {(r["label"], r["fold"]): r["n"] for r in df.join(folds, "group_id").groupBy("label", "fold").agg(F.count("w").alias("n")).collect()}
    most = {r["label"]: r["m"] for r in df.groupBy("label", "group_id").count().groupBy("label").agg(F.max("count").alias("m")).collect()}
    for label in LABELS:
        shares = [per.get((label, f), 0) for f in range(5)]
        assert max(shares) - min(shares) <= most[label]
    # The profiles of small groups beyond the bound go round, every group has one fold all the same.
    few = split.stratified_group_folds(df, 5, most=1).collect()
    assert len(few) == folds.count() and {r["fold"] for r in few} <= set(range(5))


def test_folds_of_groups_of_very_different_sizes(spark):
    """Large groups are placed by their size, also beyond any number of rows that a cap could hide."""
    placed = split.place_units([({"a": 900_000}, 1), ({"a": 500_000}, 1), ({"a": 400_000}, 1), ({"a": 10, "b": 10}, 3)], {"a": 1_800_030, "b": 30}, 3)
    assert placed[:3] == [[0], [1], [2]] and sorted(placed[3]) == [0, 1, 2]


def test_labels_may_hold_any_sign(spark):
    data = [(f"g{i}", "a+b" if i % 2 else "c", j) for i in range(12) for j in range(2)]
    train, test = split.group_split(spark.createDataFrame(data, "group_id string, label string, w int"))
    assert {r["label"] for r in train.collect()} == {r["label"] for r in test.collect()} == {"a+b", "c"}


def test_fallback_takes_about_a_fifth_but_never_all(spark):
    df = spark.createDataFrame([("a", f"a{i}") for i in range(10)] + [("b", "b0")] + [("c", "c0"), ("c", "c1")], "label string, group_id string")
    chosen = [r[0] for r in split.fallback_test_groups(df).collect()]
    assert sorted(g[0] for g in chosen) == ["a", "a", "c"]
    train, test = split.group_split(df)
    assert test.count() == 3


def test_empty_side_is_an_error(spark):
    with pytest.raises(ValueError):
        split.group_split(spark.createDataFrame([("a", "g")], "label string, group_id string"))


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert rows(split.class_weights(df)) == [("a", 3, round(4 / 6, 9)), ("b", 1, 2.0)]


def predictions(spark):
    pairs = [("normal", "normal")] * 3 + [("normal", "drowsiness")] + [("drowsiness", "drowsiness")] * 2
    return spark.createDataFrame([(t, p, f"g{i}") for i, (t, p) in enumerate(pairs)], "label string, predicted_label string, group_id string")


def test_metrics_with_a_class_absent(spark):
    df = predictions(spark)
    cm = metrics.confusion_matrix(df).orderBy("position").collect()
    assert [tuple(r)[2:] for r in cm] == [(3, 1, 0), (0, 2, 0), (0, 0, 0)]
    assert sum(sum(tuple(r)[2:]) for r in cm) == df.count()
    report = {r["name"]: r for r in metrics.classification_report(df).collect()}
    assert report["normal"]["recall"] == 0.75 and report["distraction"]["f1"] == 0.0
    assert report["macro avg"]["f1"] == pytest.approx((6 / 7 + 4 / 5) / 2)
    row = metrics.metrics_row(df, df.limit(2), model_key="m").first()
    assert row["accuracy"] == round(5 / 6, 6) and row["train_rows"] == 2 and row["test_groups"] == 6
    check = metrics.verify_accuracy(df, 5 / 6).collect()
    assert {r["difference"] for r in check} == {0.0}
    assert {r["accuracy"] for r in metrics.verify_accuracy(df.limit(0)).collect()} == {0.0}


def test_rankings(spark):
    m = spark.createDataFrame([("s", "b", "B", 0.9, 0.5, 0.1), ("s", "a", "A", 0.9, 0.5, 0.1), ("t", "a", "A", 0.2, 0.8, 0.3)],
                              "scenario string, model_key string, model_label string, accuracy double, macro_f1 double, weighted_f1 double")
    assert [(r["rank"], r["model_label"]) for r in metrics.rank_table(m, "s").collect()] == [(1, "A"), (2, "B")]
    assert rows(metrics.pivot_accuracy(m, ["s", "t"])) == [("A", 0.9, 0.2, 0.8, 0.3), ("B", 0.9, None, 0.5, 0.1)]
    with pytest.raises(ValueError):
        metrics.master_summary({"s": None})


def brute(asks, base, k):
    out = []
    for q, v in asks:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), t) for t, w in base)[:k]
        out += [(q, t, round(x, 9), i + 1) for i, (x, t) in enumerate(d)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("copies,block", [(0, 4096), (120, 16)])
def test_neighbours_equal_brute_force(spark, copies, block):
    """Also with a pile of identical training rows that fills many blocks."""
    rng = random.Random(7)
    point = lambda: [rng.gauss(0, 1) for _ in range(4)]
    base = [(i, point()) for i in range(150)] + [(1000 + i, [0.1, 0.2, 0.3, 0.4]) for i in range(copies)]
    asks = [(i, point()) for i in range(40)] + [(500, [0.1, 0.2, 0.3, 0.4])]
    make = lambda d: spark.createDataFrame(d, "id long, vec array<double>")
    got = knn.nearest_neighbours(make(asks), make(base), 5, block_rows=block)
    assert rows(got) == brute(asks, base, 5)


def test_neighbours_meet_few_units(spark):
    """Clustered points in eighteen dimensions, cut into cells and rings: the bounds leave few pairs and lose none."""
    draw = np.random.default_rng(3)
    points = draw.normal(size=(20, 18))[draw.integers(0, 20, 800)] * 4 + draw.normal(size=(800, 18)) * 0.3
    base = [(i, p.tolist()) for i, p in enumerate(points)]
    make = lambda d: spark.createDataFrame(d, "id long, vec array<double>")
    report = {}
    got = knn.nearest_neighbours(make(base[::8]), make(base), 5, block_rows=16, report=report)
    assert rows(got) == brute(base[::8], base, 5)
    assert report["units"] > 20 and report["compared"] < 0.35 * 100 * 800


def test_neighbours_without_rows(spark):
    make = lambda d: spark.createDataFrame(d, "id long, vec array<double>")
    some, none = make([(1, [0.0]), (2, None)]), make([])
    assert rows(knn.nearest_neighbours(some, none, 3)) == [] and rows(knn.nearest_neighbours(none, some, 3)) == []
    assert rows(knn.nearest_neighbours(some, some, 3)) == [(1, 1, 0.0, 1)]


def test_fewer_rows_than_neighbours(spark):
    make = lambda d: spark.createDataFrame(d, "id long, vec array<double>")
    assert knn.nearest_neighbours(make([(1, [0.0])]), make([(1, [1.0]), (2, [3.0])]), 7).count() == 2


def test_zero_distance_wins(spark):
    near = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.1, 2), (1, 3, 0.1, 3)], "query_id long, train_id long, distance double, rank int")
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "train_id long, label string")
    assert rows(knn.classify(near, labels)) == [(1, "b")]
    assert rows(knn.classify(near.filter("distance > 0"), labels)) == [(1, "a")]


def windows_table(spark):
    """Windows with separable classes."""
    rng = random.Random(1)
    data = []
    for g in range(24):
        label = LABELS[g % 3]
        for w in range(6):
            row = [rng.gauss(3.0 * (g % 3), 1.0) if i < 6 else rng.gauss(0, 1) for i in range(18)]
            data.append((label, "IR", f"f{g}", w, 1, *map(float, row)))
    cols = "label string, modality string, file_stem string, window_id int, is_usable int, " + ", ".join(f"{c} double" for c in feature_columns("baseline"))
    return spark.createDataFrame(data, cols)


@pytest.fixture(scope="module")
def fitted(spark):
    table, fits = compare_models(windows_table(spark), options=QUICK)
    return table.collect(), fits


def test_every_model_learns_and_ranks(fitted):
    table, fits = fitted
    assert len(table) == 10 and set(fits) == set(models.REGISTRY)
    assert [r["accuracy"] for r in table] == sorted((r["accuracy"] for r in table), reverse=True)
    assert {r["model_key"]: r["accuracy"] >= 0.7 for r in table} == {k: True for k in models.REGISTRY}
    assert len({(r["train_rows"], r["test_rows"]) for r in table}) == 1


def test_probabilities_are_complete(spark, fitted):
    df = windows_table(spark).limit(12)
    for key, fit in fitted[1].items():
        out = fit.predict(df)
        assert out.count() == 12, key
        for r in out.collect():
            p = [r[f"prob_{x}"] for x in LABELS]
            assert sum(p) == pytest.approx(1.0) and all(0 <= v <= 1 for v in p), key
            assert r[f"prob_{r['predicted_label']}"] == pytest.approx(max(p)), key


def test_importances(spark, fitted):
    none = {k for k, f in fitted[1].items() if models.feature_importance(spark, f) is None}
    assert none == {"knn", "rbf_svm"}
    top = [r["feature"] for r in models.feature_importance(spark, fitted[1]["random_forest"]).limit(3).collect()]
    assert set(top) <= set(feature_columns("baseline")[:6])


def test_bundles_survive_a_round_trip(spark, fitted, tmp_path):
    df = windows_table(spark).limit(20)
    for key, fit in fitted[1].items():
        fit.save(spark, f"{tmp_path}/{key}", {"feature_set": "baseline"})
        again, meta = models.load_bundle(spark, f"{tmp_path}/{key}")
        pick = lambda f: rows(f.predict(df).select("file_stem", "window_id", "predicted_label"))
        assert pick(fit) == pick(again) and meta["feature_set"] == "baseline", key


def test_unknown_names():
    assert models.resolve_models("knn, adaboost") == ["knn", "adaboost"]
    with pytest.raises(ValueError):
        models.resolve_models("oracle")


def test_grid_skips_absent_feature_sets(spark):
    table = scenario_grid({"baseline": windows_table(spark)}, scenarios=["baseline", "gaze_baseline"], models="decision_tree", options=QUICK)
    assert [r["scenario"] for r in table.collect()] == ["baseline"]
    with pytest.raises(ValueError):
        scenario_grid({}, scenarios=["nope"])


def scored(spark):
    data = [("a", 1, "normal", 0.4, 0.4, 0.2, 3.0), ("a", 2, "drowsiness", 0.4, 0.4, 0.2, 6.0), ("b", 1, "distraction", 0.1, 0.2, 0.7, 3.0)]
    return spark.createDataFrame(data, "id string, window_id int, predicted_label string, prob_normal double, prob_drowsiness double, prob_distraction double, window_end_time double")


def test_verdict_tie_goes_to_the_first_label(spark):
    got = {r["id"]: r for r in scoring.stream_verdict(scored(spark), ("id",)).collect()}
    a = got["a"]
    assert (a["overall_label"], a["overall_confidence"], a["risk_score"], a["dominant_window_count"], a["dominant_window_ratio"]) == ("normal", 0.4, 60.0, 1, 0.5)
    assert got["b"]["mean_probabilities"]["distraction"] == 0.7 and got["b"]["predicted_window_counts"]["normal"] == 0


def test_absent_class_and_risk(spark):
    df = scored(spark).drop("prob_drowsiness")
    out = scoring.window_risk(scoring.complete_probabilities(df)).orderBy("id", "window_id").collect()
    assert [r["window_risk_score"] for r in out] == [20.0, 20.0, 70.0]


def test_status_of_streams_without_windows(spark):
    v = scoring.stream_verdict(scored(spark).filter("id = 'a'"), ("id",))
    streams = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: (r["status"], r["message"]) for r in scoring.scoring_status(streams, scored(spark), v, ("id",)).collect()}
    assert got == {"a": ("ok", ""), "b": ("error", "no usable window"), "c": ("error", "no full window")}


def test_presets(spark):
    frames = spark.range(1, 1001).withColumnRenamed("id", "frame")
    kept, key = scoring.clip(frames, "quick")
    assert kept.count() == 900 and key == "xgboost_baseline"
    assert scoring.clip(frames, "full")[0].count() == 1000


@pytest.mark.parametrize("groups", [
    {"g1": "A", "g2": "AB", "g3": "B"},
    {"n1": "N", "n2": "NA", **{f"a{i}": "A" for i in range(12)}, **{f"b{i}": "B" for i in range(12)}},
])
def test_split_keeps_every_label_on_both_sides(spark, groups):
    data = [(g, label, i) for g, labels in groups.items() for label in labels for i in range(3)]
    train, test = split.group_split(spark.createDataFrame(data, "group_id string, label string, i int"))
    sides = [{r["label"] for r in side.collect()} for side in (train, test)]
    assert sides[0] == sides[1] == {label for labels in groups.values() for label in labels}
    assert not {r["group_id"] for r in train.collect()} & {r["group_id"] for r in test.collect()}
    assert train.count() + test.count() == len(data)


def test_a_side_of_some_ten_thousand_rows_is_fitted_by_several_tasks(spark):
    train = spark.range(0, 30_000, 1, 1).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "normal").otherwise("drowsiness").alias("label"))
    assert models.prepare(train, ["a"], False).rows.select(F.input_file_name()).distinct().count() > 1
    fit = models.train_model("random_forest", train, ["a"], {"numTrees": 2, "maxDepth": 2})
    assert fit.model.stages[-1].getCacheNodeIds()


def test_random_features_are_made_for_few_rows_at_a_time(spark, monkeypatch):
    import pandas as pd
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    made, real = [], models.F.pandas_udf
    monkeypatch.setattr(models.F, "pandas_udf", lambda kind: lambda f: made.append(f) or real(kind)(f))
    points = np.random.default_rng(0).normal(size=(1_300, 3))
    df = spark.createDataFrame([(p.tolist(),) for p in points], "a array<double>").coalesce(1).select(array_to_vector("a").alias("v"))
    out = models.RandomFourier(inputCol="v", outputCol="z", gamma=0.5, width=16).transform(df)
    parts = [np.vstack(z) for z in made[0](iter([pd.Series(list(points)), pd.Series([], dtype=object)]))]
    assert len(parts) > 1 and max(map(len, parts)) <= 512
    draw = np.random.default_rng(models.SEED)
    w, shift = draw.normal(0.0, 1.0, (3, 16)), draw.uniform(0.0, 2.0 * np.pi, 16)
    want = np.sqrt(2.0 / 16) * np.cos(points @ w + shift)
    assert np.allclose(np.concatenate(parts), want) and np.allclose(np.vstack([r["z"].toArray() for r in out.collect()]), want)
