"""Ordered passes over keyed series.

A *series* is every row sharing ``keys``, ordered by one integer column. Most series are short and one sorted
group per series is the cheapest plan: one shuffle, no second read. A long series would make that group a
straggler, so it is cut into chunks of consecutive order values; each chunk is scanned alone, the chunk totals
(one small row per chunk) are accumulated separately, and the result is put together by an equi join on
``(keys, chunk)``. Both plans give the same rows; ``measure`` picks one from a checked size.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framelens.config import STREAM_KEYS

CHUNK_ROWS = 262_144
MOST_PIECES = 20_000
_CHUNK = "_chunk"
_LAST_CHUNK = 2**62


@dataclass(frozen=True)
class Series:
    """Keys and order of the series in a table; ``chunk_rows=None`` means all series are known to be short.

    ``tie`` names a column that orders rows of equal or missing order value, so that both plans see one order.
    """

    keys: tuple[str, ...] = STREAM_KEYS
    order: str = "frame"
    chunk_rows: int | None = CHUNK_ROWS
    tie: str | None = None

    def by(self, *extra: str, order: str | None = None) -> "Series":
        return replace(self, keys=self.keys + extra, order=order or self.order)

    def ordered(self, order: str) -> "Series":
        return replace(self, order=order)

    def chunk(self) -> Column:
        pos = F.floor(F.col(self.order) / F.lit(float(self.chunk_rows))).cast("long")
        return F.coalesce(pos, F.lit(_LAST_CHUNK))


def measure(df: DataFrame, keys: tuple[str, ...] = STREAM_KEYS, order: str = "frame",
            limit: int = CHUNK_ROWS) -> Series:
    """Series description of ``df`` whose plan choice rests on counted rows."""
    tie = "ordinal" if "ordinal" in df.columns else None
    return Series(keys, order, None if longest(df, keys, limit) <= limit else limit, tie)


def scan(df: DataFrame, s: Series, *, running: dict[str, Column] | None = None,
         highest: dict[str, Column] | None = None, totals: dict[str, tuple[str, Column]] | None = None,
         previous: dict[str, Column] | None = None) -> DataFrame:
    """Add ordered and whole-series values to every row.

    ``running``  inclusive running sums;
    ``highest``  inclusive running maxima;
    ``totals``   whole-series ``sum``, ``min`` or ``max``;
    ``previous`` the value at the preceding row, null at the first.
    """
    folds = {**{n: (F.sum, c) for n, c in (running or {}).items()}, **{n: (F.max, c) for n, c in (highest or {}).items()}}
    plan = _scan_short if s.chunk_rows is None else _scan_chunked
    return plan(df, s, folds, totals or {}, previous or {})


def line_up(s: Series) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in (s.order, s.tie) if c]


def _scan_short(df, s, folds, totals, previous):
    ordered = Window.partitionBy(*s.keys).orderBy(*line_up(s))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*s.keys)
    return df.select(
        "*",
        *[fn(c).over(upto).alias(n) for n, (fn, c) in folds.items()],
        *[F.lag(c).over(ordered).alias(n) for n, c in previous.items()],
        *[getattr(F, fn)(c).over(whole).alias(n) for n, (fn, c) in totals.items()],
    )


def _scan_chunked(df, s, folds, totals, previous):
    keyed = df.withColumn(_CHUNK, s.chunk())
    position = F.coalesce(F.col(s.order), F.lit(_LAST_CHUNK))
    if s.tie:
        position = F.struct(position, F.col(s.tie))
    parts = keyed.groupBy(*s.keys, _CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[fn(c).alias(f"_r_{n}") for n, (fn, c) in folds.items()],
        *[getattr(F, fn)(c).alias(f"_t_{n}") for n, (fn, c) in totals.items()],
        *[F.max_by(c, position).alias(f"_p_{n}") for n, c in previous.items()],
    )
    chunks = Window.partitionBy(*s.keys).orderBy(_CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*s.keys)
    offsets = parts.select(
        *s.keys, _CHUNK,
        *[fn(f"_r_{n}").over(before).alias(f"_r_{n}") for n, (fn, _) in folds.items()],
        *[F.lag(f"_p_{n}").over(chunks).alias(f"_p_{n}") for n in previous],
        *[getattr(F, fn)(f"_t_{n}").over(whole).alias(n) for n, (fn, _) in totals.items()],
    )
    inner = Window.partitionBy(*s.keys, _CHUNK).orderBy(*line_up(s))
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = keyed.select(
        "*",
        *[fn(c).over(upto).alias(f"_l_{n}") for n, (fn, c) in folds.items()],
        *[F.lag(c).over(inner).alias(f"_q_{n}") for n, c in previous.items()],
        *([F.row_number().over(inner).alias("_at")] if previous else []),
    )
    joined = local.join(offsets, [*s.keys, _CHUNK])
    return joined.select(
        *df.columns,
        *[_with_before(fn, f"_l_{n}", f"_r_{n}").alias(n) for n, (fn, _) in folds.items()],
        *[F.when(F.col("_at") == 1, F.col(f"_p_{n}")).otherwise(F.col(f"_q_{n}")).alias(n) for n in previous],
        *totals,
    )


def _with_before(fn, local: str, before: str) -> Column:
    """A chunk's own running value joined with that of the chunks before it; null means nothing was seen yet."""
    if fn is F.max:
        return F.greatest(local, before)
    return F.coalesce(F.col(local) + F.col(before), F.col(local), F.col(before))


def longest(df: DataFrame, keys: list[str] | tuple[str, ...], limit: int = CHUNK_ROWS) -> int:
    """Rows of the largest group; a table within the limit is not grouped at all, its size is the answer."""
    total = df.count()
    if total <= limit:
        return total
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def ordinal(df: DataFrame, keys: list[str], order: list, name: str = "frame", limit: int = CHUNK_ROWS,
            top: int | None = None) -> DataFrame:
    """Row number per key in the order of ``order`` (column names or expressions), also if one key holds most rows.

    Keys within ``limit`` rows are ranked by a plain window. The rows of longer keys are range-partitioned on the
    whole sort key, which balances them by sampling however the values repeat, written once, and numbered by
    partition offsets. ``top`` is the size of the largest key if it is known.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*[c.asc_nulls_last() for c in by])
    plain = lambda rows: rows.withColumn(name, F.row_number().over(w).cast("long"))
    if (longest(df, keys, limit) if top is None else top) <= limit:
        return plain(df)
    sizes = df.groupBy(*keys).count().filter(F.col("count") > limit)
    # A table of n rows has at most n / limit long keys, so their list is short by construction.
    long_keys = stage(sizes.select(*keys))
    rest = plain(df.join(long_keys, list(keys), "left_anti"))
    rows = df.join(long_keys, list(keys), "left_semi")
    # Offsets do not depend on the size of a piece, so their number is bounded.
    pieces = min(MOST_PIECES, max(2, -(-sizes.agg(F.sum("count")).first()[0] // limit)))
    lined = rows.repartitionByRange(pieces, *keys, *by).sortWithinPartitions(
        *[F.col(k) for k in keys], *[c.asc_nulls_last() for c in by])
    # The written copy fixes which row lies in which partition and at which place.
    held = stage(lined.withColumns({"_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = held.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = held.join(offsets.select(*keys, "_piece", "_from", "_before"), [*keys, "_piece"])
    place = (F.col("_at") - F.col("_from") + F.col("_before") + 1).cast("long")
    return rest.unionByName(numbered.select(*df.columns, place.alias(name)))


def stage_folder(spark: SparkSession) -> str:
    """The shared folder the session names; only a local master may go without one and gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="framelens-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate as a table in the shared folder and go on from there.

    The written copy outlives lost executors, ends the lineage, and is read back by column and with true sizes,
    which keeps plans of many rounds small. It is removed when the session's JVM ends, or by ``drop_stage`` before.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = path
    return back


def drop_stage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again; other tables are left alone."""
    for t in tables:
        path = getattr(t, "_staged", None)
        if path:
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, s: Series) -> DataFrame:
    """Write an intermediate of long series once, because every pass over them reads its input twice."""
    return df if s.chunk_rows is None else stage(df)


def attach(df: DataFrame, s: Series, facts: DataFrame) -> DataFrame:
    """Add per-series facts (one row per series) to every row, spreading a long series over its chunks."""
    if s.chunk_rows is None:
        return df.join(facts, list(s.keys))
    keyed = df.withColumn(_CHUNK, s.chunk())
    spread = keyed.select(*s.keys, _CHUNK).distinct().join(facts, list(s.keys))
    return keyed.join(spread, [*s.keys, _CHUNK]).drop(_CHUNK)


def median_positive_step(df: DataFrame, s: Series, column: str, default: float, width: float) -> DataFrame:
    """Exact median per series of the positive differences between neighbouring values of ``column``.

    A long series is reduced to counts per distinct difference first; ``width`` is the span of differences
    that one chunk of that reduced table covers.
    """
    stepped = scan(df, s, previous={"_before": F.col(column)})
    gap = (F.col(column) - F.col("_before")).cast("double")
    steps = stepped.select(*s.keys, F.when(gap > 0, gap).alias("_d"))
    if s.chunk_rows is None:
        median = steps.groupBy(*s.keys).agg(F.percentile("_d", F.lit(0.5)).alias("median"))
    else:
        counts = steps.groupBy(*s.keys, "_d").agg(F.count("_d").alias("_n"))
        ranked = scan(counts, Series(s.keys, "_d", width), running={"_upto": F.col("_n")},
                      totals={"_all": ("sum", F.col("_n"))})
        at = lambda p: F.max(F.when((F.col("_upto") >= p) & (F.col("_upto") - F.col("_n") < p), F.col("_d")))
        lower, upper = F.floor((F.col("_all") - 1) / 2) + 1, F.floor(F.col("_all") / 2) + 1
        median = ranked.groupBy(*s.keys).agg(((at(lower) + at(upper)) / 2).alias("median"))
    return median.withColumn("median", F.coalesce("median", F.lit(float(default))))
