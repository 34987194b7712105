"""Boosted trees: both plans, every kind, against plain loops over the definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import boosting
from framelens.operators.boosting import Boost, Side, boost

KINDS = [
    Boost("newton", 3, 20, 3, 0.3, penalty=1.0, least=1.0, rows=0.8, columns=0.7),
    Boost("residual", 3, 20, 3, 0.3),
    Boost("samme", 3, 20, 2, 0.5),
]


def data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 4))
    x[:, 0] += 2.0 * code
    x[:, 1] -= 1.5 * (code == 2)
    x[:, 3] = np.round(x[:, 3])
    return x, code


def side(spark, x, code, parts=3):
    rows = [(*map(float, v), float(c), 2.0 if c == 1 else 1.0) for v, c in zip(x, code)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, code double, weight double").repartition(parts)
    return Side(df, ["a", "b", "c", "d"], len(rows))


def accuracy(fit, x, code):
    return (fit.scores(list(x.T)).argmax(axis=1) == code).mean()


def test_level_plan_and_task_plan_grow_the_same_trees(spark):
    x, code = data()
    s = side(spark, x, code)
    one, many = [boost([(s, spec) for spec in KINDS], whole) for whole in (10_000, 0)]
    for a, b in zip(one, many):
        assert len(a.rounds) == len(b.rounds) == 20
        assert np.abs(a.scores(list(x.T)) - b.scores(list(x.T))).max() < 1e-9
        for r, q in zip(a.rounds, b.rounds):
            assert all((t.feature == u.feature).all() and (t.cut == u.cut).all() for t, u in zip(r.trees, q.trees))


def test_many_partitions_are_added_in_spark(spark, monkeypatch):
    monkeypatch.setattr(boosting, "FEW", 2)
    monkeypatch.setattr(boosting, "KEEP", 2)
    x, code = data(90)
    s = side(spark, x, code, 9)
    spec = Boost("residual", 3, 5, 2, 0.3)
    (a,), (b,) = boost([(s, spec)], 0), boost([(s, spec)], 1000)
    assert np.abs(a.scores(list(x.T)) - b.scores(list(x.T))).max() < 1e-9


def test_fits_of_several_sides_do_not_mix(spark):
    (x, code), (y, other) = data(120, 1), data(150, 2)
    a, b = side(spark, x, code), side(spark, y, other)
    spec = Boost("newton", 3, 6, 3, 0.3, penalty=1.0)
    together = boost([(a, spec), (b, spec), (a, KINDS[2])], 0)
    for fit, alone, rows in zip(together, [boost([(a, spec)], 0)[0], boost([(b, spec)], 0)[0], boost([(a, KINDS[2])], 0)[0]], [x, y, x]):
        assert np.abs(fit.scores(list(rows.T)) - alone.scores(list(rows.T))).max() < 1e-9


@pytest.mark.parametrize("spec", KINDS, ids=lambda s: s.kind)
def test_unseen_rows_are_told_apart(spark, spec):
    x, code = data(400, 3)
    fit = boost([(side(spark, x, code), spec)])[0]
    y, other = data(400, 4)
    assert accuracy(fit, x, code) > 0.8 and accuracy(fit, y, other) > 0.75


def gini_stump(x, code, w, k):
    """Best split of one node by exhaustive search: (gain, feature, value)."""
    worth = lambda m: sum(w[m & (code == c)].sum() ** 2 for c in range(k)) / max(w[m].sum(), 1e-300)
    every = np.ones(len(x), bool)
    return max((worth(x[:, f] <= v) + worth(x[:, f] > v) - worth(every), -f, -v) for f in range(x.shape[1]) for v in np.unique(x[:, f])[:-1])


def test_first_split_is_the_best_there_is(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 8, (80, 4)).astype(float)  # few values, so that no quantile is missed
    code = ((x[:, 2] > 3).astype(int) + (rng.random(80) < 0.1)) % 3
    s = side(spark, x, code)
    tree = boost([(s, Boost("samme", 3, 1, 1, 1.0))])[0]
    gain, f, v = gini_stump(x, code, 1.0 + (code == 1), 3)
    root = tree.rounds[0].trees[0]
    assert root.feature[0] == -f and root.gain[0] == pytest.approx(gain)
    assert tree.cuts[-f][root.cut[0]] == -v


def test_newton_leaves(spark):
    """One split on one feature: leaves are G / (H + penalty) at equal starting scores."""
    x = np.array([[0.0, 0, 0, 0]] * 6 + [[1.0, 0, 0, 0]] * 6)
    code = np.array([0] * 5 + [1] + [1] * 5 + [2])
    df = side(spark, x, code)
    tree = boost([(df, Boost("newton", 3, 1, 1, 1.0, penalty=1.0))])[0].rounds[0].trees[0]
    w = 1.0 + (code == 1)
    for leaf, rows in ((1, slice(0, 6)), (2, slice(6, 12))):
        g, h = ((code[rows] == 0) - 1 / 3) @ w[rows], (2 * (1 / 3) * (2 / 3) * w[rows]).sum()
        assert tree.value[leaf] == pytest.approx(g / (h + 1.0))


def test_perfect_and_useless_features(spark):
    x = np.zeros((30, 4))
    code = np.arange(30) % 3
    x[:, 0] = code
    fit = boost([(side(spark, x, code), Boost("samme", 3, 20, 2, 0.5))])[0]
    assert len(fit.rounds) == 1 and accuracy(fit, x, code) == 1.0  # no error is left
    blank = boost([(side(spark, x * 0, code), spec) for spec in KINDS])
    for fit in blank:
        assert np.allclose(fit.scores(list(x.T)).sum(axis=1), 1.0) and sum(fit.importances()) == 0


def test_missing_values_go_right(spark):
    x, code = data(200, 5)
    x[code == 2, 0] = np.nan
    fit = boost([(side(spark, x, code), KINDS[0])])[0]
    assert accuracy(fit, x, code) > 0.8


def test_predictions_of_a_table(spark):
    x, code = data(120, 6)
    s = side(spark, x, code)
    fit = boost([(s, KINDS[1])])[0]
    fit.classes = ["distraction", "drowsiness", "normal"]
    out = fit.predict(s.rows.withColumn("id", F.monotonically_increasing_id())).collect()
    for r in out:
        p = fit.scores([np.array([r[f]]) for f in s.features])[0]
        assert [r[f"prob_{c}"] for c in fit.classes] == pytest.approx(p) and r["predicted_label"] == fit.classes[int(p.argmax())]
    assert fit.predict(s.rows.limit(0)).count() == 0


def test_the_driver_gets_splits_and_no_sums(spark, monkeypatch):
    x, code = data(90)
    df = side(spark, x, code, 6)
    rows = boosting.stage(boosting.binned(df, boosting.cut_points(df), 0, 3).repartition(6))
    seen, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    growth = boosting.Growth(KINDS[0], 4)
    boosting._level(rows, [(0, growth)], 6)
    assert sum(len(bytes(v)) for part in seen for r in part for v in r if isinstance(v, (bytes, bytearray))) < 1000 < 8 * growth.cells


def test_the_lesser_child_tells_the_sums_of_its_sibling():
    x, code = data(3000)
    spec, bins = KINDS[0], np.clip((x * 8 + 32), 0, 63).astype(np.uint8)
    block = boosting.Block(bins, code, np.ones(len(code)), np.arange(len(code)), np.zeros((len(code), 3)))
    growth, stats, above = boosting.Growth(spec, 4), block.statistics(spec, 0), None
    trees, counted = growth.rounds[0].trees, [np.arange(len(code))] * 3
    for level in range(spec.depth):
        nodes = [t.leaf(bins) for t in trees]
        whole, above = block.sums(spec, stats, nodes, level), block.sums(spec, stats, nodes, level, counted, above)
        assert np.abs(whole - above).max() < 1e-9
        boosting.split_level(growth, [boosting.best_splits(growth, 1, t, cells) for t, cells in enumerate(whole)])


def test_a_side_of_many_rows_needs_no_job_for_each_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_level", lambda *_: pytest.fail("a job for a level"))
    rows = spark.range(30_000).select(*[F.rand(i).alias(c) for i, c in enumerate("abcd")], (F.col("id") % 3).cast("double").alias("code"),
                                      F.lit(1.0).alias("weight")).withColumn("a", F.col("a") + F.col("code"))
    fit = boost([(Side(rows, list("abcd"), 30_000), Boost("newton", 3, 8, 3, 0.3, penalty=1.0, least=1.0))])[0]
    pdf = rows.toPandas()
    assert len(fit.rounds) == 8 and accuracy(fit, pdf[list("abcd")].to_numpy(), pdf["code"].to_numpy()) > 0.9
