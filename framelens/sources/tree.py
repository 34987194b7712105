"""Folders of very many files, listed, read and written by tasks.

Spark's own sources keep every file's name and place on the driver, open each file through a planned scan, and put written
files in place one by one. Here folders are rows of a table: tasks list them level by level, and a task reads or writes its
files itself, so that the driver holds no list and a small file costs about a millisecond.

This needs a folder that tasks reach by a plain path, as Spark's ``file:`` folders must be; ``plain`` tells. Other file systems,
large files (which Spark splits) and files in a rare form go through Spark's sources.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import shutil
import urllib.parse
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framelens.operators.series import stage

#: Bytes of the largest file that one task reads whole; rows passed on at a time; files and bytes that a task reads.
SMALL, ROWS, FILES, BYTES = 4 << 20, 20_000, 2_000, 64 << 20
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")


def plain(spark: SparkSession, root: str) -> str | None:
    """The path of a folder that tasks reach by it; ``None`` if Spark has to read it (another file system, a file, a pattern)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    named = system.makeQualified(place).toString()
    return named.removeprefix("file:") if named.startswith("file:/") and system.isDirectory(place) else None


def may_write(spark: SparkSession, root: str) -> str | None:
    """The path of a folder to write, there or not, if tasks reach it by a plain path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    named = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return named.removeprefix("file:") if named.startswith("file:/") else None


def name_pattern(glob: str) -> str:
    """A pattern of file names (``*``, ``?``, ``[...]``, ``{a,b}``, backslash) as a regular expression."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2)
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "[" and end > 0:
            body = glob[i + 1:end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    return out


def _hidden(name: str) -> bool:
    """Names that Spark's sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, size`` of the files below ``root`` whose names match; one level of folders a job."""
    pattern, kind = re.compile(name_pattern(glob), re.DOTALL), "path string, size long"

    def entries(batches):
        for pdf in batches:
            for folder in pdf["path"]:
                with os.scandir(folder) as found:
                    for e in found:
                        if not _hidden(e.name):
                            if e.is_dir():
                                yield e.path, None
                            elif pattern.fullmatch(e.name):
                                yield e.path, e.stat().st_size

    def scan(batches):
        # Folders may hold one file each, so entries are passed on by number and not by folder.
        every = entries(batches)
        while some := [*itertools.islice(every, ROWS)]:
            yield pd.DataFrame(some, columns=["path", "size"]).astype({"size": "Int64"})

    files, folders = [], spark.createDataFrame([(root,)], "path string")
    while True:
        level = stage(folders.mapInPandas(scan, kind))
        files.append(level.filter("size IS NOT NULL"))
        n = level.filter("size IS NULL").count()
        if not n:
            break
        folders = level.filter("size IS NULL").select("path").repartition(_tasks(spark, n, 0))
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return stage(out)


def _tasks(spark: SparkSession, files: int, size: int) -> int:
    least = min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return max(1, least, -(-files // FILES), -(-size // BYTES))


def dealt(files: DataFrame) -> DataFrame:
    """Files with their ``size``, dealt out to the tasks that read them."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(_tasks(files.sparkSession, n, size))


# --- reading ------------------------------------------------------------------------------------------------------


def cells(line: str, separator: str) -> list[str]:
    """The fields of a delimited line, as ``files.cells`` finds them."""
    if '"' not in line:
        return line.split(separator)
    if line[0] == line[-1] == '"':
        plain_cells = line[1:-1].split(f'"{separator}"')
        if line.count('"') == 2 * len(plain_cells):
            return plain_cells
    field = rf'{separator}(\s*"(?:[^"]|"")*"\s*(?=$|{separator})|[^{separator}]*)'
    found = re.findall(field, separator + line, re.ASCII)
    return [c.strip(" ")[1:-1].replace('""', '"') if len(c.strip(" ")) > 1 and c.strip(" ")[0] == c.strip(" ")[-1] == '"' else c for c in found]


def _text_lines(path: str, is_header: re.Pattern) -> tuple[str | None, list[str]]:
    """The first line that matches, and the lines that do not and hold something."""
    with open(path, "rb") as f:
        text = f.read().decode("utf-8", "replace")
    first, rest = None, []
    for v in re.split("\r\n|\r|\n", text):
        v = v.removeprefix("\ufeff")
        if v.strip(" "):
            if is_header.search(v):
                first = v if first is None else first
            else:
                rest.append(v)
    return first, rest


def _header(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII | re.IGNORECASE)


def text_heads(files: DataFrame, header: str) -> DataFrame:
    """``path, line, _filled`` of small text files: the first line that matches ``header``, and whether there are others."""
    is_header = _header(header)

    def run(batches):
        for batch in batches:
            found = [(path, *_text_lines(path, is_header)) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()),
                                              pa.array([bool(f[2]) for f in found])], names=["path", "line", "_filled"])

    return dealt(files).mapInArrow(run, "path string, line string, _filled boolean")


def text_rows(files: DataFrame, header: str, columns: tuple[str, ...]) -> DataFrame:
    """``path, ordinal`` and the cells of ``columns`` as text, of the lines of small text files that have a header."""
    is_header = _header(header)
    kinds = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), *[(c, pa.string()) for c in columns]])

    def parts(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                head, lines = _text_lines(path, is_header)
                by = ";" if ";" in head else ","
                names = [re.sub("[\"']", "", c).strip(" ") for c in cells(head, by)]
                places = [names.index(c) if c in names else None for c in columns]
                for lo in range(0, len(lines), ROWS):
                    fields = [cells(v, by) for v in lines[lo:lo + ROWS]]
                    n = len(fields)
                    yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(range(lo, lo + n), pa.int64()), *[
                        pa.nulls(n, pa.string()) if i is None else pa.array([f[i] if i < len(f) else None for f in fields], pa.string())
                        for i in places]], schema=kinds)

    return dealt(files).mapInArrow(lambda batches: _gathered(parts(batches), kinds),
                                   ", ".join(["path string, ordinal long", *[f"`{c}` string" for c in columns]]))


def _numeric(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_float64(kind) or pa.types.is_null(kind)


def _columns(names: list[str], clean, columns: tuple[str, ...], known: dict) -> dict[str, list[str]]:
    """The columns of a file by the names they stand for; ``known`` holds those of earlier files."""
    key = tuple(names)
    if key not in known:
        known.clear()
        known[key] = {c: [n for n in names if clean(n) == c] for c in columns}
    return known[key]


def _numbers(table: pa.RecordBatch, names: list[str]) -> pa.Array:
    """The first value of the columns of one name; not-a-number is no value."""
    out = pa.nulls(table.num_rows, pa.float64())
    if names:
        out = pc.coalesce(*[table.column(n).cast(pa.float64(), safe=False) for n in names])
        out = pc.if_else(pc.is_nan(out), pa.scalar(None, pa.float64()), out)
    return out


def _values(batch: pa.RecordBatch, names: list[str]) -> int:
    """How many rows have a number, or one if the first has."""
    if len(names) == 1 and batch.num_rows:
        first = batch.column(names[0])[0].as_py()
        if first is not None and first == first:
            return 1
    return batch.num_rows - _numbers(batch, names).null_count


def number_counts(files: DataFrame, clean, columns: tuple[str, ...]) -> DataFrame:
    """``path, size, plain, rows`` of Parquet files and for each column a number that is 0 if no row has a value: ``plain`` files
    hold ``columns`` as whole or double numbers only, and only of these there are counts."""
    most, known = SMALL, {}

    def run(batches):
        for batch in batches:
            out = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                with pq.ParquetFile(path) as file:
                    schema = file.schema_arrow
                    by = _columns(schema.names, clean, columns, known)
                    fit = size <= most and all(_numeric(schema.field(n).type) for v in by.values() for n in v)
                    row = {"path": path, "size": size, "plain": fit, "rows": file.metadata.num_rows, **dict.fromkeys(columns, 0)}
                    for part in file.iter_batches(ROWS, columns=[n for v in by.values() for n in v], use_threads=False) if fit else ():
                        for c, names in by.items():
                            row[c] += _values(part, names)
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("plain", pa.bool_()), ("rows", pa.int64()), *[(c, pa.int64()) for c in columns]])
    return dealt(files).mapInArrow(run, ", ".join(["path string, size long, plain boolean, rows long", *[f"`{c}` long" for c in columns]]))


def _gathered(parts, kinds: pa.Schema):
    """Small batches put together."""
    some, n = [], 0
    for part in parts:
        some, n = [*some, part], n + part.num_rows
        if n >= ROWS:
            yield from pa.Table.from_batches(some, kinds).combine_chunks().to_batches()
            some, n = [], 0
    if some:
        yield from pa.Table.from_batches(some, kinds).combine_chunks().to_batches()


def numbers(files: DataFrame, clean, columns: tuple[str, ...]) -> DataFrame:
    """``path, ordinal`` and ``columns`` as doubles of the rows of plain Parquet files."""
    kinds = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), *[(c, pa.float64()) for c in columns]])

    def parts(batches):
        known, some, n = {}, [], 0

        def together():
            # Files of the same columns are turned into numbers together.
            table = pa.Table.from_batches([t for _, t, _ in some]).combine_chunks()
            whole = table.to_batches()[0]
            paths = pa.concat_arrays([pa.repeat(path, t.num_rows) for path, t, _ in some])
            places = pa.array(np.concatenate([np.arange(at, at + t.num_rows) for _, t, at in some]))
            by = _columns(whole.schema.names, clean, columns, known)
            return pa.RecordBatch.from_arrays([paths, places, *[_numbers(whole, by[c]) for c in columns]], schema=kinds)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with pq.ParquetFile(path) as file:
                    by, at = _columns(file.schema_arrow.names, clean, columns, known), 0
                    wanted = [n for v in by.values() for n in v]
                    if not wanted:  # it has rows nevertheless
                        yield from _blank(path, file.metadata.num_rows, kinds)
                        continue
                    for part in file.iter_batches(ROWS, columns=wanted, use_threads=False):
                        if some and (n >= ROWS or not part.schema.equals(some[0][1].schema, check_metadata=False)):
                            yield together()
                            some, n = [], 0
                        if part.num_rows:
                            some.append((path, part.replace_schema_metadata(None), at))
                        n, at = n + part.num_rows, at + part.num_rows
        if some:
            yield together()

    return dealt(files).mapInArrow(parts, ", ".join(["path string, ordinal long", *[f"`{c}` double" for c in columns]]))


def _blank(path: str, rows: int, kinds: pa.Schema):
    for at in range(0, rows, ROWS):
        n = min(ROWS, rows - at)
        yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(range(at, at + n), pa.int64()),
                                          *[pa.nulls(n, k.type) for k in [*kinds][2:]]], schema=kinds)


def read_keyed(spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    """Rows of the Parquet files of a ``key=value/...`` tree, whose folders name the ``keys``."""
    stored = T.StructType([f for f in schema if f.name not in keys])
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(stored)
    kinds = pa.schema([*[(k, pa.string()) for k in keys], *types])

    def parts(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = dict(p.split("=", 1) for p in path.removeprefix(root).split("/")[:-1] if "=" in p)
                values = [None if found[k] == NO_VALUE else urllib.parse.unquote(found[k]) for k in keys]
                with pq.ParquetFile(path) as file:
                    for part in file.iter_batches(ROWS, columns=types.names, use_threads=False):
                        own = [pa.array([v] * part.num_rows, pa.string()) for v in values]
                        yield pa.RecordBatch.from_arrays([*own, *[part.column(f.name).cast(f.type) for f in types]], schema=kinds)

    out = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *stored])
    rows = dealt(listing(spark, root, "*")).mapInArrow(lambda batches: _gathered(parts(batches), kinds), out)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


# --- writing ------------------------------------------------------------------------------------------------------

#: Types that Arrow writes as Spark does.
_WRITTEN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType,
            T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.DecimalType)


def writable(schema: T.StructType) -> bool:
    return all(type(f.dataType) in _WRITTEN for f in schema)


class _Text:
    def __init__(self, path: str, head: str):
        self.file = open(path, "w", encoding="utf-8", newline="")
        self.file.write(head)

    def write(self, batch: pa.RecordBatch) -> None:
        self.file.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()))

    def close(self) -> None:
        self.file.close()


class _Columns:
    def __init__(self, path: str, schema: pa.Schema):
        self.file = pq.ParquetWriter(path, schema, compression="snappy")

    def write(self, batch: pa.RecordBatch) -> None:
        self.file.write_batch(batch)

    def close(self) -> None:
        self.file.close()


def write_files(rows: DataFrame, place, head: str | None = None) -> int:
    """Write each run of rows of equal ``_file`` to the file ``place(_file, task)`` names, and count the files.

    Rows must be sorted by ``_file`` within partitions. Files are Parquet, or lines of text under ``head``. A file gets its
    name when it is whole, so a repeated task leaves nothing twice; a series of any length takes the memory of one batch.
    """
    kinds = T.StructType([f for f in rows.schema if f.name != "_file"]).json()

    def run(batches):
        n, now, at, writer = 0, None, "", None

        def close() -> int:
            if writer is None:
                return 0
            writer.close()
            os.replace(f"{os.path.dirname(at)}/.{os.path.basename(at)}.{mark}", at)
            return 1

        mark = uuid.uuid4().hex
        for batch in batches:
            data = batch.drop_columns(["_file"])
            schema = data.schema.with_metadata({"org.apache.spark.sql.parquet.row.metadata": kinds})
            runs, lo = pc.run_end_encode(batch.column("_file")), 0
            for name, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if name != now or writer is None:
                    n += close()
                    now, at = name, place(name, TaskContext.get().partitionId())
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    part = f"{os.path.dirname(at)}/.{os.path.basename(at)}.{mark}"
                    writer = _Columns(part, schema) if head is None else _Text(part, head)
                writer.write(data.slice(lo, hi - lo).replace_schema_metadata(schema.metadata))
                lo = hi
        n += close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def key_values(columns: list) -> Column:
    """What ``key_names`` turns into names of files and folders."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))


def key_names(values: str) -> list[str]:
    """Values as Spark's writer names folders after them."""
    return [_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else NO_VALUE for v in json.loads(values)]


def write_keyed(df: DataFrame, root: str, keys: tuple[str, ...], spread: list, tasks: int, mode: str) -> None:
    """Rows below ``root`` as a ``key=value/...`` tree of Parquet files, laid out as Spark's writer does.

    What is overwritten goes when the new tree is whole.
    """
    there = os.path.isdir(root)
    if there and mode == "ignore":
        return
    if there and mode not in ("overwrite", "append"):
        raise ValueError(f"{root} is there already")
    job, to = uuid.uuid4().hex, f"{root.rstrip('/')}-{uuid.uuid4().hex}" if mode == "overwrite" else root.rstrip("/")

    def place(file: str, task: int) -> str:
        folders = "/".join(f"{k}={v}" for k, v in zip(keys, key_names(file)))
        return f"{to}/{folders}/part-{task:05d}-{job}.c000.snappy.parquet"

    named = df.repartition(tasks, *spread).withColumn("_file", key_values([F.col(k) for k in keys]))
    write_files(named.drop(*keys).sortWithinPartitions("_file"), place)
    os.makedirs(to, exist_ok=True)
    open(f"{to}/_SUCCESS", "w").close()
    if mode == "overwrite":
        if there:
            shutil.rmtree(root)
        os.replace(to, root)
