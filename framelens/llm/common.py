"""What the text operators share: words of a text, bounded memos, and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII lower case, the rest of the text unchanged.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch; texts of a batch are held together, so it is small.
BATCH_ROWS = 256


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space (bytes.split cuts exactly at 0x20 and 0x09-0x0D)."""
    return text.encode("utf-8").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []  # bytes.lower changes A-Z only


def remainder(column: str, n: int) -> Column:
    """crc32 of the number as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


class Memo(dict):
    """A memo that starts anew once it is full, so that its memory is bounded however many words there are."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self._make, self._limit = make, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._make(key)
        return value


class Ragged:
    """Lists of ids by key, laid out in one array; starts anew once it is full.

    ``make`` gives the ids of new keys as 32-bit numbers packed into bytes.
    """

    def __init__(self, make: Callable[[list], list[bytes]], limit: int = 1_000_000):
        self._make, self._limit = make, limit
        self._clear()

    def _clear(self) -> None:
        self._at: dict = {}
        self._flat, self._starts, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all keys one after the other, and how many each key has."""
        if len(self._at) > self._limit:
            self._clear()
        at = np.fromiter(map(self._at.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            made = self._make(new)
            self._at.update(zip(new, range(len(self._at), len(self._at) + len(new))))
            own = lengths(made) // 4
            self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(own) - own])
            self._sizes = np.concatenate([self._sizes, own])
            self._flat = np.concatenate([self._flat, np.frombuffer(b"".join(made), np.int32)])
            count = len(self._at)
            at[missing] = range(count - len(new), count) if len(new) == len(missing) else [self._at[keys[i]] for i in missing]
        sizes = self._sizes[at]
        return self._flat[spread(self._starts[at], sizes)], sizes


def in_slices(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """The batches in pieces of a few rows, because what is made of the texts is many times their size."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo:lo + rows]


def mapped(df: DataFrame, batches: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    return df.mapInPandas(batches, schema)


class Scratch:
    """Intermediate tables of one operator, written to the folder that the session names as shared.

    A written table outlives lost executors and cuts the lineage. ``drop`` removes what a later round has replaced;
    the rest goes when the session's JVM ends. Only a local master may go without a named folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            base = tempfile.mkdtemp(prefix="framelens-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir()
        self.folder = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._scratch = self  # a table is not read after its owner is gone
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def sweep(self) -> None:
        """Let the driver collect its garbage after a round. Spark removes shuffle files, broadcasts and the tables of its
        broadcast joins, whose pages take megabytes however few rows they hold, only once the driver has done so."""
        self.spark._jvm.java.lang.System.gc()

    def close(self) -> None:
        """Remove all tables; nothing that reads them may be used afterwards."""
        self.sweep()
        self._paths.clear()
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), True)


#: Rows of a narrow table that is sent to every task; larger ones are joined by shuffle.
SMALL = 500_000


def small_or_not(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it was counted as small."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column is called so; Spark does not tell cases apart."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def numbered(docs: DataFrame, scratch: Scratch, stored: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row that stays the same however often it is read, and the number's column.

    ``stored`` says that ``docs`` is a Parquet table read from files: then file and place in the file make the number and
    nothing is copied. Any other table is written with its numbers.
    """
    row = free_name("row", docs.columns)
    if stored and "_metadata" not in {c.lower() for c in docs.columns}:
        path, at = free_name("path", docs.columns), free_name("place", docs.columns)
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
        files = sorted(r[0] for r in placed.select(path).distinct().collect())  # names of files, not rows
        if len(files) < 1 << 22:
            named = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{row} long, {path} string")
            joined = placed.join(F.broadcast(named), path)  # a file takes 2**41 rows at most
            return joined.select(*docs.columns, (F.shiftleft(F.col(row), 41) + F.col(at)).alias(row)), row
    return scratch.write(docs.withColumn(row, F.monotonically_increasing_id())), row


def lengths(lists: list[list]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def group_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of ``values``; empty runs give zero."""
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - sizes]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
