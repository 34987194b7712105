"""Every registered query against the SQL that states its result, and long series against short ones."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from framelens.plans.catalog import ORACLE, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


#: Thousands of iterations, once or many times: a minute or more each. The driver of the queries runs them.
LENGTHY = {"compare_models", "scenario_grid", "train_linear_svm", "train_rbf_svm"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - LENGTHY))
def test_query_equals_sql(spark, root, duck, name):
    df = QUERIES[name](spark, root)
    columns = sorted(df.columns)
    got = sorted([text(r[c]) for c in columns] for r in df.collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([text(r[i]) for i in at] for r in result.fetchall()) and got


LONG = ("window_features", "gaze_window_features", "extract_normal_frames", "greedy_match", "diff_normal_frames",
        "stratified_group_split", "segment_stats", "self_audit")


@pytest.mark.parametrize("name", LONG)
def test_chunked_plan_gives_the_same_rows(spark, root, name):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(QUERIES[name](spark, root)) == rows(QUERIES[name](spark, root, 50))


@pytest.mark.parametrize("name", ("window_features", "gaze_window_features", "segment_stats"))
def test_one_series_with_a_third_of_all_rows(spark, root, tmp_path, name):
    """The hot series takes the chunked plan beside short ones, and nothing changes."""
    events = spark.read.parquet(f"{root}/events.parquet")
    events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id"))).write.parquet(
        f"{tmp_path}/events.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, str(tmp_path), 100))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
