"""Delimited frame and gaze files, per-series output and versioned tables."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from framelens.config import FRAME_COLUMNS, GAZE_COLUMNS, GAZE_FILE_SUFFIX, GAZE_REQUIRED, OPTIONAL_FRAME_COLUMNS, STREAM_KEYS
from framelens.functions.naming import stream_keys
from framelens.operators.series import Series, stage
from framelens.sources import tree

BOM = "﻿"


def clean_name(name: str) -> str:
    return name.strip().replace('"', "").replace("'", "")


def cells(line: Column, separator: str) -> Column:
    """The fields of a delimited line. A field in double quotes may hold the separator, and a doubled quote stands for one."""
    # Every field is read with the separator before it; one is put before the first.
    field = rf'{separator}(\s*"(?:[^"]|"")*"\s*(?=$|{separator})|[^{separator}]*)'
    found = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(field), F.lit(1))
    return F.transform(found, lambda c: F.when(F.trim(c).rlike('(?s)^".*"$'), F.regexp_replace(
        F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')).otherwise(c))


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks and quotes."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def _text(spark: SparkSession, root: str | list[str], glob: str) -> DataFrame:
    """Lines with their file and a position that grows along the file."""
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
             .select(F.regexp_replace("value", f"^{BOM}", "").alias("line"),
                     F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
                     F.col("_metadata.file_block_start").alias("start"))
             .filter(~F.col("name").startswith("~$") & ~F.col("name").startswith("~%24") & (F.trim("line") != "")))
    # Splits of a file start at least 1 KiB apart and hold fewer than 2^29 lines.
    place = F.shiftleft(F.shiftright("start", 10), 29) + F.monotonically_increasing_id().bitwiseAND((1 << 29) - 1)
    return lines.select("line", F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("path"), place.alias("ordinal"))


def _listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Paths of the files, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    shown = files.filter(~name.startswith("~$") & ~name.startswith("~%24"))
    return shown.select(F.url_decode(F.regexp_replace("path", r"\+", "%2B")).alias("path"))


def qualified(spark: SparkSession, root: str) -> str:
    """The folder as its file system names it, with scheme and without a relative part."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def read_delimited(spark: SparkSession, root: str, columns: tuple[str, ...], required: tuple[str, ...], *,
                   glob: str = "*.csv", anchor: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Numeric tables of a folder, whatever each file's delimiter and column order, and error rows.

    Each file's header names its columns; ``;`` is the delimiter unless that leaves a single column. A file without
    a required column is an error row; unparsable values are null.
    """
    rows, files = _delimited(spark, root, columns, required, glob, anchor)
    return rows, files.filter("error IS NOT NULL")


def _delimited(spark: SparkSession, root: str, columns: tuple[str, ...], required: tuple[str, ...], glob: str,
               anchor: str = "frame") -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be read, and every file with its error, which is null if there is none."""
    header = rf"(^|[;,\s\"']){anchor}($|[;,\s\"'])"
    place = tree.plain(spark, root)
    if place is None:
        lines = _text(spark, root, glob)
        # The listing, and not the lines, tells which files there are: an empty one has no line.
        files = stage(_judged(_listing(spark, root, glob).join(_headers(lines, header), "path", "left"), required))
        return _parsed_lines(lines, header, files, columns), files.select("path", "error")
    listed = tree.listing(spark, place, glob)
    shown, small = _shown(listed), (F.col("size") <= tree.SMALL) & ~F.lower("path").rlike(PACKED)
    others = [r["path"] for r in shown.filter(~small).select("path").collect()]  # large files, and few for their bytes
    own = tree.text_heads(shown.filter(small), header)
    files = _judged(own, required)
    if others:
        lines = _text(spark, [_literal_path(p) for p in others], glob)
        named = shown.filter(~small).select(_uri("path").alias("path"))
        files = files.unionByName(_judged(named.join(_headers(lines, header), "path", "left"), required).withColumn("path", F.substr("path", F.lit(len(SCHEME) + 1))))
    files = stage(files)
    known = shown.filter(small).join(files.filter("error IS NULL").select("path"), "path", "left_semi")
    found = tree.text_rows(known, header, columns)
    rows = found.select(_uri("path").alias("path"), "ordinal", *[_number(F.trim(F.translate(c, "\"'", "")), c) for c in columns])
    named = files.withColumn("path", _uri("path"))
    if others:
        rows = rows.unionByName(_parsed_lines(lines, header, named, columns))
    return rows, named.select("path", "error")


#: Endings of files that Spark unpacks as it reads them, and how its sources name files of plain paths.
PACKED, SCHEME = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$", "file:"


def _uri(path: str) -> Column:
    return F.concat(F.lit(SCHEME), F.col(path))


def _shown(listed: DataFrame) -> DataFrame:
    """Without the lock files that office programs leave."""
    return listed.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def _literal_path(path: str) -> str:
    """A path that is not taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _split(line: Column, by: Column) -> Column:
    return F.when(by == ";", cells(line, ";")).otherwise(cells(line, ","))


def _separator() -> Column:
    return F.when(F.col("line").contains(";"), ";").otherwise(",")


def _names() -> Column:
    return F.transform(_split(F.col("line"), _separator()), lambda c: F.trim(F.regexp_replace(c, "[\"']", "")))


def _headers(lines: DataFrame, header: str) -> DataFrame:
    """One pass tells the header ``line`` of each file and whether it has other lines."""
    is_header = F.col("line").rlike("(?i)" + header)
    return lines.groupBy("path").agg(F.min_by("line", F.when(is_header, F.col("ordinal"))).alias("line"), F.bool_or(~is_header).alias("_filled"))


def _judged(files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``path, _sep, _names, error`` of files with their header ``line`` and whether they are ``_filled``."""
    files = files.select("path", _separator().alias("_sep"), _names().alias("_names"), F.when(F.col("_filled"), True).alias("_filled"))
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), F.coalesce("_names", F.array().cast("array<string>")))
    files = files.withColumn("_missing", missing)
    error = (F.when(F.col("_names").isNull() & F.col("_filled").isNull(), "no rows")
             .when(F.size("_missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("_missing", ", ")))
             .when(F.col("_filled").isNull(), "no rows"))
    return files.select("path", "_sep", "_names", error.alias("error"))


def _parsed_lines(lines: DataFrame, header: str, files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    known = files.filter("error IS NULL").select("path", "_sep", "_names")
    return _parsed(lines.filter(~F.col("line").rlike("(?i)" + header)).join(known, "path"), columns)


def _parsed(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``path, ordinal`` and ``columns`` of lines with the delimiter and the names of their file."""
    parsed = lines.withColumn("_cells", _split(F.col("line"), F.col("_sep")))
    return parsed.select("path", "ordinal", *[_cell(c) for c in columns])


def _cell(name: str) -> Column:
    raw = F.get(F.col("_cells"), F.array_position("_names", F.lit(name)).cast("int") - 1)
    return _number(F.trim(F.regexp_replace(raw, "[\"']", "")), name)


def _number(raw: Column, name: str) -> Column:
    """A cell as a number; what is no number, not-a-number included, is null, so that it never passes a threshold."""
    value = raw.try_cast("double")
    value = F.when(~F.isnan(value), value)
    return (value.cast("long") if name == "frame" else value).alias(name)


def _one_schema(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The files as few tables: all in one if their column types agree, else by halves."""
    try:
        return [spark.read.option("mergeSchema", "true").parquet(*[_literal_path(p) for p in paths])]
    except Exception as e:
        if len(paths) == 1 or "merge" not in str(e).lower():
            raise
    half = len(paths) // 2
    return _one_schema(spark, paths[:half]) + _one_schema(spark, paths[half:])


def _stored(spark: SparkSession, root: str, glob: str, listed: DataFrame) -> list[DataFrame]:
    """The listed files as few tables: the folder as a whole if its files agree, as naming many files costs a task for each."""
    if listed.isEmpty():
        return []
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if whole.format("binaryFile").load(root).select("path").join(listed, "path", "left_anti").isEmpty():
        try:
            return [whole.option("mergeSchema", "true").format("parquet").load(root)]
        except Exception as e:
            if "merge" not in str(e).lower():
                raise
    return _one_schema(spark, sorted(r["path"] for r in listed.collect()))  # names of files


def read_columnar(spark: SparkSession, root: str, columns: tuple[str, ...], required: tuple[str, ...], *,
                  glob: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """The same from Parquet files of one or several schemas; names are cleaned as headers are.

    A column is missing from a file if no row of the file has a value in it. Files without rows are error rows.
    """
    rows, files = _columnar(spark, root, columns, required, glob)
    return rows, files.filter("error IS NOT NULL")


def _columnar(spark: SparkSession, root: str, columns: tuple[str, ...], required: tuple[str, ...],
              glob: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be read, and every file with its error, which is null if there is none."""
    place = tree.plain(spark, root)
    if place is None:
        listed = stage(_listing(spark, root, glob))
        return _columnar_scan(spark, _stored(spark, root, glob, listed), listed, columns, required)
    counted = stage(tree.number_counts(_shown(tree.listing(spark, place, glob)), clean_name, columns))
    own, other = counted.filter("plain"), counted.filter("NOT plain").select(_uri("path").alias("path"))
    absent = F.array_compact(F.array(*[F.when(F.col(c) == 0, c) for c in required]))
    error = F.when(F.col("rows") == 0, "no rows").when(F.size(absent) > 0, F.concat(F.lit("missing columns: "), F.array_join(absent, ", ")))
    files = stage(own.select("path", "size", error.alias("error")))
    found = tree.numbers(files.filter("error IS NULL").select("path", "size"), clean_name, columns)
    rows = found.select(_uri("path").alias("path"), "ordinal", *[_number(F.col(c), c) for c in columns])
    files = files.select(_uri("path").alias("path"), "error")
    if other.isEmpty():
        return rows, files
    other = stage(other)
    tables = (_stored(spark, root, glob, other) if files.isEmpty() else _one_schema(spark, sorted(r["path"] for r in other.collect())))
    more, judged = _columnar_scan(spark, tables, other, columns, required)
    return rows.unionByName(more), files.unionByName(judged)


def _columnar_scan(spark: SparkSession, tables: list[DataFrame], listed: DataFrame, columns: tuple[str, ...],
                   required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The same by Spark's own source, for the ``listed`` files read as ``tables``."""
    kinds = ", ".join(f"{c} {'long' if c == 'frame' else 'double'}" for c in columns)
    rows = spark.createDataFrame([], f"path string, ordinal long, {kinds}")
    for stored in tables:
        # Files may write a name differently; the schema has every spelling, and a file fills one of them.
        cell = lambda c: F.coalesce(F.lit(None).cast("string"), *[
            F.col(f"`{n}`").cast("string") for n in stored.columns if clean_name(n) == c])
        rows = rows.unionByName(stored.select(
            F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("path"),
            F.col("_metadata.row_index").alias("ordinal"), *[_number(cell(c), c) for c in columns]))
    seen = rows.groupBy("path").agg(*[F.count(c).alias(c) for c in required])
    files = listed.join(seen.withColumn("_filled", F.lit(True)), "path", "left")
    absent = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) == 0, c) for c in required]))
    error = F.when(F.col("_filled").isNull(), "no rows").when(F.size(absent) > 0, F.concat(F.lit("missing columns: "), F.array_join(absent, ", ")))
    files = stage(files.select("path", error.alias("error")))
    return rows.join(files.filter("error IS NOT NULL").select("path"), "path", "left_anti"), files


def read_tables(spark: SparkSession, root: str, columns: tuple[str, ...], required: tuple[str, ...], glob: str) -> tuple[DataFrame, DataFrame]:
    """Rows of delimited or columnar files, by the ending that ``glob`` names, and every file with its error or null."""
    read = _columnar if glob.lower().endswith(".parquet") else _delimited
    return read(spark, root, columns, required, glob)


def _with_keys(df: DataFrame, root: str, suffix: str = "") -> DataFrame:
    keys = stream_keys(F.col("path"), qualified(df.sparkSession, root), suffix)
    return df.withColumns({n: c for n, c in keys.items()})


def _split_errors(rows: DataFrame, files: DataFrame, root: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """Rows under their series, and the files that give none. The files decide, so that the rows are read once, by the caller."""
    errors = files.filter("error IS NOT NULL")
    named = _with_keys(files.filter("error IS NULL").select("path"), root, suffix)
    bad = named.filter("path_error is not null").select("path", F.col("path_error").alias("error"))
    named = named.filter("path_error is null").select(*STREAM_KEYS, "path")
    # Files that would become one series are errors, not a series with every frame twice.
    several = stage(named.groupBy(*STREAM_KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*STREAM_KEYS))
    twice = named.join(several, list(STREAM_KEYS)).select("path", F.lit("series name of several files").alias("error"))
    good = _with_keys(rows, root, suffix).filter("path_error is null")
    good = good.join(several, list(STREAM_KEYS), "left_anti").drop("path", "path_error", "relative_path")
    return good, errors.unionByName(bad).unionByName(twice)


def read_frames(spark: SparkSession, root: str, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Frame series of a ``label/modality/stem`` tree of delimited or (``*.parquet``) columnar files, and error rows
    ``(path, error)``."""
    required = tuple(c for c in FRAME_COLUMNS if c not in OPTIONAL_FRAME_COLUMNS)
    rows, found = read_tables(spark, root, FRAME_COLUMNS, required, glob)
    return _split_errors(rows, found, root, "")


def read_gaze(spark: SparkSession, root: str, glob: str = "*.csv", strict: bool = False,
              suffix: str = GAZE_FILE_SUFFIX) -> tuple[DataFrame, DataFrame]:
    """Gaze series; ``strict`` asks for all fifteen columns instead of the five that features need."""
    rows, found = read_tables(spark, root, GAZE_COLUMNS, GAZE_COLUMNS if strict else GAZE_REQUIRED, glob)
    return _split_errors(rows, found, root, suffix)


#: Tasks put their files in place themselves; otherwise the driver moves the file of every series, one after the other.
TASKS_COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def writers(spark: SparkSession) -> int:
    """Tasks that write one file for each series. Their time goes with the files, so that small rows must not merge them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def write_per_stream(df: DataFrame, root: str, s: Series = Series(), mode: str = "overwrite") -> None:
    """One folder per series; a long series is written by several tasks."""
    spark = df.sparkSession
    spread = list(s.keys) if s.chunk_rows is None or s.order not in df.columns else [*s.keys, s.chunk()]
    place = tree.may_write(spark, root)
    if place and tree.writable(df.schema) and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static":
        return tree.write_keyed(df, place, s.keys, spread, writers(spark), mode)
    df.repartition(writers(spark), *spread).write.mode(mode).option(*TASKS_COMMIT).partitionBy(*s.keys).parquet(root)


def read_per_stream(spark: SparkSession, root: str, schema: StructType, s: Series = Series()) -> DataFrame:
    """The rows that ``write_per_stream`` wrote, with the columns of ``schema``."""
    place = tree.plain(spark, root)
    if place and tree.writable(schema):
        return tree.read_keyed(spark, place, schema, s.keys)
    return spark.read.schema(schema).parquet(root).select(*schema.names)


def write_versioned(df: DataFrame, folder: str, name: str, now: datetime | None = None) -> str:
    """Write beside earlier versions; returns the version."""
    version = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    df.write.mode("errorifexists").parquet(f"{folder}/{name}/run_ts={version}")
    return version


def read_latest(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The newest version of a table."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    found = [f.getPath().getName() for f in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)]
    newest = max(f for f in found if f.startswith("run_ts="))
    return spark.read.parquet(f"{folder}/{name}/{newest}")
