"""Ordered passes give the same rows whether a series is scanned whole or in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from framelens.operators.series import Series, attach, measure, median_positive_step, ordinal, scan
from tests.helpers import LONG, PLANS, SHORT, rows


def skewed(spark, n=400):
    """One key with most rows, frames with gaps."""
    rng = random.Random(3)
    data, at = [], {}
    for _ in range(n):
        key = "hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}"
        at[key] = at.get(key, rng.randrange(40)) + rng.choice([1, 1, 1, 2, 9])
        data.append((key, at[key], rng.choice([None, 1.0, 2.5, -4.0])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "id string, frame long, v double"), data


def test_scan_matches_plain_python(spark):
    df, data = skewed(spark)
    want = []
    for key in {d[0] for d in data}:
        total, top, last = None, None, None
        series = sorted((d for d in data if d[0] == key), key=lambda d: d[1])
        values = [d[2] for d in series if d[2] is not None]
        for _, frame, v in series:
            total = total if v is None else (total or 0.0) + v
            top = top if v is None else v if top is None else max(top, v)
            want.append((key, frame, total, top, last, min(values) if values else None, len(series)))
            last = v
    for s in PLANS:
        out = scan(df, s, running={"total": F.col("v")}, highest={"top": F.col("v")}, previous={"last": F.col("v")},
                   totals={"least": ("min", F.col("v")), "n": ("sum", F.lit(1))})
        assert rows(out.select("id", "frame", "total", "top", "last", "least", "n")) == sorted(want, key=repr)


def test_ordinal_of_a_hot_key_with_repeated_first_column(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 5}", rng.randrange(2), i) for i in range(300)]
    df = spark.createDataFrame(data, "id string, ts long, e long")
    plain = rows(ordinal(df, ["id"], ["ts", "e"]))
    assert plain == rows(ordinal(df, ["id"], ["ts", "e"], limit=25))
    assert {r[3] for r in plain if r[0] == "hot"} == set(range(1, 201))


def test_measure_picks_the_plan_from_counts(spark):
    df, _ = skewed(spark)
    assert measure(df, ("id",), limit=1000).chunk_rows is None
    assert measure(df, ("id",), limit=50).chunk_rows == 50
    assert measure(df.filter("id <> 'hot'"), ("id",), limit=50).chunk_rows is None


@pytest.mark.parametrize("values,median", [([1, 2, 4, 8], 2.0), ([1, 2, 4, 9, 10], 1.5), ([5], 0.25), ([3, 3, 2], 0.25)])
def test_median_step(spark, values, median):
    """Steps that are not positive do not count; without a step the default holds."""
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "id string, frame long, t double")
    for s in PLANS:
        assert rows(median_positive_step(df, s, "t", 0.25, 0.5)) == [("a", median)]


def test_attach_spreads_facts(spark):
    df, _ = skewed(spark)
    facts = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    assert rows(attach(df, SHORT, facts).select("id", "frame", "n")) == rows(attach(df, LONG, facts).select("id", "frame", "n"))


def test_plans_use_the_expected_shuffles(spark):
    """A short series needs one shuffle; a long one is shuffled by key and chunk."""
    df, _ = skewed(spark)
    plan = lambda s: scan(df, s, running={"r": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert plan(SHORT).count("Exchange hashpartitioning(id") == 1
    assert "hashpartitioning(id" in plan(LONG) and "_chunk" in plan(LONG)
    assert "CartesianProduct" not in plan(LONG) and "NestedLoop" not in plan(LONG)


def test_null_order_values_come_last(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("a", 1, 1.0), ("a", 20, 2.0)], "id string, frame long, v double")
    for s in PLANS:
        got = {r["frame"]: r["r"] for r in scan(df, s, running={"r": F.col("v")}).collect()}
        assert got == {1: 1.0, 20: 3.0, None: 8.0}


def test_series_helpers():
    s = Series(("a",))
    assert s.by("b").keys == ("a", "b") and s.ordered("w").order == "w"
