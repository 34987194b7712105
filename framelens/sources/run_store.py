"""Stored runs and their window predictions, appended batch by batch.

A batch is everything that is stored at one moment, and a folder of its own: ``runs/batch=yyyyMMdd_HHmmss`` beside
``windows/batch=...``. Storing a batch again replaces its folders, so a job that is repeated after a failure leaves no row
twice. Batches sort by time, so the newest runs are found by reading the newest folders only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelens.operators.scoring import prediction_rows, recent_runs, run_rows

RUNS, WINDOWS = "runs", "windows"


def batch_name(created_at: datetime) -> str:
    return created_at.strftime("%Y%m%d_%H%M%S")


def store_runs(folder: str, verdicts: DataFrame, quality: DataFrame, predictions: DataFrame, keys: tuple[str, ...], *, model_key: str,
               feature_set: str, created_at: datetime, fast_mode: bool = True) -> str:
    """Write a batch; returns its name. The windows go first: a run that can be seen has all its windows."""
    moment, batch = F.to_timestamp(F.lit(created_at.strftime("%Y-%m-%d %H:%M:%S"))), batch_name(created_at)
    windows = prediction_rows(predictions, keys, created_at=moment)
    runs = run_rows(verdicts, quality, keys, model_key=model_key, feature_set=feature_set, created_at=moment, fast_mode=fast_mode)
    for name, rows in ((WINDOWS, windows), (RUNS, runs)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    return batch


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the stored batches, the newest first; one folder each."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{RUNS}")
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(base):
        return []
    names = [f.getPath().getName() for f in system.listStatus(base)]
    return sorted((n.removeprefix("batch=") for n in names if n.startswith("batch=")), reverse=True)


def stored(spark: SparkSession, folder: str, name: str = RUNS, only: list[str] | None = None) -> DataFrame:
    """Rows of all batches or of some, with their batch."""
    rows = spark.read.schema(_schema(spark, folder, name) + ", batch string").parquet(f"{folder}/{name}")
    return rows if only is None else rows.filter(F.col("batch").isin(only))  # a filter on the folder's name reads no other folder


def _schema(spark: SparkSession, folder: str, name: str) -> str:
    """Columns of the newest batch, so that opening the store does not look into every file."""
    newest = batches(spark, folder)[0]
    return ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(f"{folder}/{name}/batch={newest}").dtypes)


def newest_runs(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    """The ``n`` latest runs, read from as few of the newest batches as hold them."""
    names, found, used = batches(spark, folder), 0, []
    for batch in names:
        if found >= n:
            break
        used.append(batch)
        found += stored(spark, folder, RUNS, [batch]).limit(n).count()
    if not names:
        raise ValueError("no runs are stored")
    return recent_runs(stored(spark, folder, RUNS, used), n)


def windows_of(spark: SparkSession, folder: str, run_id: int, batch: str) -> DataFrame:
    """Windows of one stored run in order."""
    return stored(spark, folder, WINDOWS, [batch]).filter(F.col("analysis_id") == run_id).drop("batch").orderBy("window_id")
