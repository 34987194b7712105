"""Queries over names, paths and landmark geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid
from datetime import datetime
from multiprocessing.pool import ThreadPool

from framelens.config import GAZE_FILE_SUFFIX
from framelens.functions import geometry, naming
from framelens.operators.series import stage_folder
from framelens.plans.registry import K, Inputs, query, shown, sql
from framelens.plans.window_queries import KEYS
from framelens.sources import files, listing, tree

URL_PATH = "regexp_replace(url, '^https?://|[?#].*$', '', 'g')"


def url_paths(x: Inputs):
    """Page addresses as file paths: host, language, number."""
    path = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    return x.table("pages").select("page_id", path.alias("path"))


@query("stream_keys", f"""SELECT page_id, path AS relative_path, p[1] AS label, p[2] AS modality,
  regexp_replace(p[-1], '\\.[^.]*$', '') AS file_stem,
  CASE WHEN len(p) < 3 THEN 'unexpected path structure' WHEN p[1] NOT IN ('normal', 'drowsiness', 'distraction') THEN 'unknown label'
    WHEN p[2] NOT IN ('IR', 'RGB') THEN 'unknown modality' END AS path_error
FROM (SELECT page_id, path, string_split(path, '/') AS p FROM (SELECT page_id,
  CASE page_id % 4 WHEN 0 THEN 'normal/IR/' WHEN 1 THEN 'drowsiness/RGB/' WHEN 2 THEN 'distraction/UV/' ELSE '' END || {URL_PATH} AS path FROM pages))""")
def _(x):
    k = F.col("page_id") % 4
    prefix = F.when(k == 0, "normal/IR/").when(k == 1, "drowsiness/RGB/").when(k == 2, "distraction/UV/").otherwise("")
    paths = url_paths(x).withColumn("path", F.concat(F.lit("/data/"), prefix, "path"))
    keys = naming.stream_keys(F.col("path"), "/data")
    return paths.select("page_id", *[c.alias(n) for n, c in keys.items()])


def folder(x: Inputs) -> str:
    """A folder of its own in the shared place, gone when the session ends."""
    path = f"{stage_folder(x.spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    place = x.spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(x.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@query("read_delimited", sql(f"SELECT frame, {shown('time_sec', 'avg_ear')} FROM frames", "frames"))
def _(x):
    """Frames written as text with another delimiter, quoted names and columns in another order, and read back."""
    root = folder(x)
    rows = x.frames().select("avg_ear", F.col("time_sec").alias(" time_sec "), F.lit("?").alias("note"), "frame")
    rows.write.option("header", "true").option("sep", ";").option("quoteAll", "true").csv(root)
    return files.read_delimited(x.spark, root, ("frame", "time_sec", "avg_ear"), ("frame", "avg_ear"))[0].drop("path", "ordinal")


@query("read_errors", "SELECT 'missing columns: absent' AS error, true AS nothing_read")
def _(x):
    """Files without a wanted column give error rows and nothing else."""
    root = folder(x)
    x.frames().select("frame", "avg_ear").write.option("header", "true").csv(root)
    rows, errors = files.read_delimited(x.spark, root, ("frame", "absent"), ("frame", "absent"))
    return errors.select("error", F.lit(rows.isEmpty()).alias("nothing_read")).distinct()


@query("write_per_stream", sql(f"SELECT {K}, frame, {shown('avg_ear')} FROM frames", "frames"))
def _(x):
    root = folder(x)
    rows = x.frames().select(*KEYS, "frame", "avg_ear")
    files.write_per_stream(rows, root, x.series())
    return files.read_per_stream(x.spark, root, rows.schema, x.series())


@query("read_latest", sql(f"SELECT {K}, frame, 2 AS version FROM frames", "frames"))
def _(x):
    """Two versions of the whole table are written, the newer one is read."""
    root, rows = folder(x), x.frames().select(*KEYS, "frame")
    for version in (2, 1):  # the newer one first, so that the name decides and not the time of writing
        files.write_versioned(rows.withColumn("version", F.lit(version)), root, "frames", datetime(2024, 1, version))
    return files.read_latest(x.spark, root, "frames")


STORED = ("frame", "time_sec", "face_detected", "yaw", "pitch", "roll", "pose_valid", "left_ear", "right_ear", "avg_ear", "ear_valid", "ear_suspicious")
STORED_SQL = f"""SELECT {K}, frame, {shown('time_sec', 'yaw', 'pitch', 'roll', 'avg_ear')}, face_detected::DOUBLE AS face_detected,
  pose_valid::DOUBLE AS pose_valid, ear_valid::DOUBLE AS ear_valid, ear_suspicious::DOUBLE AS ear_suspicious,
  round(avg_ear + 3e-9, 7) AS left_ear, round(avg_ear + 3e-9, 7) AS right_ear FROM frames"""


def as_stored(x: Inputs):
    """The frames with the columns of a frame file."""
    return x.frames().withColumns({"left_ear": F.col("avg_ear"), "right_ear": F.col("avg_ear")}).select(*KEYS, *STORED)


#: Files moved at a time.
MOVES = 16


def write_tree(rows, root: str, ending: str) -> None:
    """Files of a ``label/modality/stem`` tree, one for each series, by the writer's own layout."""
    spark = rows.sparkSession
    place = tree.may_write(spark, root)
    if place:
        return _write_files(rows, place, ending)
    hadoop = spark._jvm.org.apache.hadoop.fs
    named = rows.withColumns({"_l": F.col("label"), "_m": F.col("modality"), "_s": F.col("file_stem")}).drop(*KEYS)
    writer = named.repartition(files.writers(spark), "_l", "_m", "_s").write.option(*files.TASKS_COMMIT).partitionBy("_l", "_m", "_s")
    if ending == "csv":
        writer.option("header", "true").option("sep", ";").option("quoteAll", "true").csv(root + "-parts")
    else:
        writer.parquet(root + "-parts")
    base = hadoop.Path(root + "-parts")
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(base)
    places: set[str] = set()

    def move(at) -> None:
        path = at.getPath()
        label, modality, stem = (p.split("=", 1)[1] for p in path.toString().split("/")[-4:-1])
        to = f"{root}/{label}/{modality}"
        if to not in places:
            system.mkdirs(hadoop.Path(to))
            places.add(to)
        system.rename(path, hadoop.Path(f"{to}/{stem}.{ending}"))

    with ThreadPool(MOVES) as pool:
        for _ in pool.imap_unordered(move, system.globStatus(hadoop.Path(root + f"-parts/*/*/*/*.{ending}")), chunksize=64):
            pass


def _write_files(rows, place: str, ending: str) -> None:
    """The same by the tasks themselves."""
    head, file = None, tree.key_values([F.col(k) for k in KEYS])
    named = rows.repartition(files.writers(rows.sparkSession), *KEYS).withColumn("_file", file).drop(*KEYS)
    if ending == "csv":
        columns, style = [c for c in named.columns if c != "_file"], {"sep": ";", "quoteAll": "true"}
        head = ";".join(f'"{c}"' for c in columns) + "\n"
        named = named.select("_file", F.to_csv(F.struct(*columns), style).alias("line"))
    tree.write_files(named.sortWithinPartitions("_file"), lambda name, _: f"{place}/{'/'.join(tree.key_names(name))}.{ending}", head)


def _frames_query(ending: str):
    @query(f"read_frames_{ending}", sql(STORED_SQL, "frames"))
    def _(x):
        """Frames stored as one file for each series and read back, with the series named by the path."""
        root = folder(x)
        write_tree(as_stored(x), root, ending)
        rows, errors = files.read_frames(x.spark, root, f"*.{ending}")
        if not errors.isEmpty():
            raise ValueError("files of the tree were refused")
        return rows.select(*KEYS, *STORED)


for _ending in ("csv", "parquet"):
    _frames_query(_ending)


GAZE_READ = ("frame", "time_sec", "face_detected", "iris_x_norm", "iris_y_norm")


@query("read_gaze", sql(f"""SELECT {K}, frame, {shown('time_sec', 'iris_x_norm', 'iris_y_norm')}, face_detected::DOUBLE AS face_detected FROM frames""", "frames"))
def _(x):
    """Gaze samples in columnar files whose names have the ending of gaze files; not-a-number is read as null."""
    root, nan = folder(x), F.lit(float("nan"))
    rows = x.frames().select("label", "modality", F.concat("file_stem", F.lit(GAZE_FILE_SUFFIX)).alias("file_stem"), "frame", "time_sec", "face_detected",
                             F.coalesce("iris_x_norm", nan).alias(" iris_x_norm"), F.coalesce("iris_y_norm", nan).alias("iris_y_norm"))
    write_tree(rows, root, "parquet")
    return files.read_gaze(x.spark, root, "*.parquet")[0].select(*KEYS, *GAZE_READ)


@query("limit_streams", sql(f"""SELECT {K}, frame FROM frames WHERE ({K}) IN (SELECT {K} FROM (SELECT DISTINCT {K} FROM frames)
  ORDER BY {K} LIMIT 20)""", "frames"))
def _(x):
    return listing.limit_streams(x.frames().select(*KEYS, "frame"), tuple(KEYS), 20)


@query("limit_streams_per_group", sql(f"""SELECT {K}, frame FROM frames JOIN (SELECT {K}, row_number() OVER
  (PARTITION BY label, modality ORDER BY file_stem) AS r FROM (SELECT DISTINCT {K} FROM frames)) USING ({K}) WHERE r <= 3""", "frames"))
def _(x):
    return listing.limit_streams(x.frames().select(*KEYS, "frame"), tuple(KEYS), 3, per=("label", "modality"))


@query("unique_sources", f"""SELECT name, path FROM (SELECT *, row_number() OVER (PARTITION BY name
  ORDER BY CASE WHEN contains(lower(path), 'therha') THEN 0 ELSE 1 END, len(path), path) AS r
FROM (SELECT DISTINCT path, lower(string_split(path, '/')[-1]) AS name FROM (SELECT {URL_PATH} AS path FROM pages))) WHERE r = 1""")
def _(x):
    return listing.unique_sources(url_paths(x).select("path").distinct(), "therha")


@query("filter_sources", """SELECT c_custkey, name FROM (SELECT c_custkey,
  lower(c_name) || CASE WHEN c_custkey % 3 = 0 THEN '_ir_face_std' ELSE '_rgb_face_std' END ||
  CASE WHEN c_custkey % 5 = 0 THEN '.txt' ELSE '.MP4' END AS name FROM customer)
WHERE contains(lower(name), '_ir_face_std') AND lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.mp4', '.avi', '.mov', '.mkv')""")
def _(x):
    c = F.col("c_custkey")
    name = F.concat(F.lower("c_name"), F.when(c % 3 == 0, "_ir_face_std").otherwise("_rgb_face_std"),
                    F.when(c % 5 == 0, ".txt").otherwise(".MP4"))
    named = x.table("customer").select("c_custkey", name.alias("name"))
    return named.filter(listing.source_filter(F.col("name"), "IR", (".mp4", ".avi", ".mov", ".mkv")))




@query("infer_label", """SELECT doc_id, CASE WHEN contains(n, 'normal') THEN 'normal' WHEN contains(n, 'drowsiness') THEN 'drowsiness'
  WHEN contains(n, 'distraction') THEN 'distraction' WHEN contains(n, 'sleep') OR contains(n, 'uyku') THEN 'drowsiness'
  WHEN contains(n, 'dikkat') THEN 'distraction' ELSE 'uploaded' END AS label,
  CASE WHEN contains(n, 'ir') THEN 'IR' ELSE 'RGB' END AS modality
FROM (SELECT doc_id, lower(source || CASE doc_id % 8 WHEN 0 THEN '_Normal' WHEN 1 THEN '_DROWSINESS_normal' WHEN 2 THEN '_distraction'
  WHEN 3 THEN '_Sleepy' WHEN 4 THEN '_uyku' WHEN 5 THEN '_dikkat' WHEN 6 THEN '_sleep_distraction' ELSE '_ir' END || lang) AS n FROM documents)""")
def _(x):
    k = F.col("doc_id") % 8
    part = (F.when(k == 0, "_Normal").when(k == 1, "_DROWSINESS_normal").when(k == 2, "_distraction").when(k == 3, "_Sleepy")
            .when(k == 4, "_uyku").when(k == 5, "_dikkat").when(k == 6, "_sleep_distraction").otherwise("_ir"))
    name = F.concat("source", part, "lang")
    return x.table("documents").select("doc_id", naming.label_of(name).alias("label"), naming.modality_of(name).alias("modality"))


# --- geometry: vector components play coordinates -------------------------------------------------------------

def v(i: int):
    return F.get(F.col("embedding"), F.lit(i)).cast("double")


def d(i: int) -> str:
    return f"embedding[{i + 1}]::DOUBLE"


def points(at: int):
    return [F.struct(v(at + 2 * i).alias("x"), v(at + 2 * i + 1).alias("y")) for i in range(6)]


def dist(a: int, b: int) -> str:
    return f"sqrt(({d(a)} - {d(b)}) ** 2 + ({d(a + 1)} - {d(b + 1)}) ** 2)"


def ear_sql(at: int, least: str) -> str:
    p = [at + 2 * i for i in range(6)]
    return f"CASE WHEN {dist(p[0], p[3])} >= {least} THEN ({dist(p[1], p[5])} + {dist(p[2], p[4])}) / (2 * {dist(p[0], p[3])}) END"


@query("ear", f"""SELECT vec_id, {shown('l', 'r')}, round((l + r) / 2 + 3e-9, 7) AS avg_ear,
  CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1 ELSE 0 END AS ear_valid
FROM (SELECT vec_id, {ear_sql(0, '0.05')} AS l, {ear_sql(12, '0.05')} AS r FROM embeddings)""")
def _(x):
    least = F.lit(0.05)
    both = x.table("embeddings").select("vec_id", geometry.eye_aspect_ratio(points(0), least).alias("l"),
                                        geometry.eye_aspect_ratio(points(12), least).alias("r"))
    avg = geometry.average_ear(F.col("l"), F.col("r"))
    return both.select("vec_id", "l", "r", avg.alias("avg_ear"), avg.isNotNull().cast("int").alias("ear_valid"))


@query("euler_angles", f"""SELECT vec_id,
  round(degrees(CASE WHEN sy < 1e-6 THEN atan2(-{d(5)}, {d(4)}) ELSE atan2({d(7)}, {d(8)}) END) + 3e-9, 7) AS pitch,
  round(degrees(atan2(-{d(6)}, sy)) + 3e-9, 7) AS yaw,
  round(degrees(CASE WHEN sy < 1e-6 THEN 0.0 ELSE atan2({d(3)}, {d(0)}) END) + 3e-9, 7) AS roll
FROM (SELECT *, sqrt({d(0)} ** 2 + {d(3)} ** 2) AS sy FROM embeddings)""")
def _(x):
    r = [[v(3 * i + j) for j in range(3)] for i in range(3)]
    return x.table("embeddings").select("vec_id", *[c.alias(n) for n, c in geometry.euler_angles(r).items()])


def wrap_sql(e: str) -> str:
    return f"(({e} + 180.0) - 360.0 * floor(({e} + 180.0) / 360.0) - 180.0)"


@query("normalize_angles", f"""SELECT vec_id, round({wrap_sql('CASE WHEN p > 90 THEN 180.0 - p WHEN p < -90 THEN -180.0 - p ELSE p END')} + 3e-9, 7) AS pitch,
  round(CASE WHEN abs(p) > 90 THEN {wrap_sql('(y + 180.0)')} ELSE y END + 3e-9, 7) AS yaw,
  round(CASE WHEN abs(p) > 90 THEN {wrap_sql('(r + 180.0)')} ELSE r END + 3e-9, 7) AS roll
FROM (SELECT vec_id, {wrap_sql(f'({d(0)} * 900)')} AS p, {wrap_sql(f'({d(1)} * 900)')} AS y, {wrap_sql(f'({d(2)} * 900)')} AS r FROM embeddings)""")
def _(x):
    angles = geometry.normalize_angles(v(0) * 900.0, v(1) * 900.0, v(2) * 900.0)
    return x.table("embeddings").select("vec_id", *[c.alias(n) for n, c in angles.items()])


@query("pose_valid", f"""SELECT vec_id, ok AS pose_valid, round(CASE WHEN ok = 1 THEN y END + 3e-9, 7) AS yaw,
  CASE WHEN vec_id % 5 <> 0 AND (ok = 0 OR abs(y) > 35) THEN 1 ELSE 0 END AS ear_suspicious
FROM (SELECT *, CASE WHEN p BETWEEN -60 AND 60 AND y BETWEEN -90 AND 90 AND r BETWEEN -50 AND 50 AND e <= 12 THEN 1 ELSE 0 END AS ok
  FROM (SELECT vec_id, {d(0)} * 300 AS p, {d(1)} * 300 AS y, {d(2)} * 300 AS r, abs({d(3)}) * 60 AS e FROM embeddings))""")
def _(x):
    ok = geometry.pose_valid(v(0) * 300.0, v(1) * 300.0, v(2) * 300.0, F.abs(v(3)) * 60.0)
    checked = x.table("embeddings").select("vec_id", ok.alias("pose_valid"), F.when(ok == 1, v(1) * 300.0).alias("yaw"))
    eye = F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0)
    return checked.withColumn("ear_suspicious", geometry.ear_suspicious(eye, F.col("yaw")))


@query("ear_suspicious", sql(f"SELECT {K}, frame, ear_suspicious FROM frames", "frames"))
def _(x):
    return x.frames().select(*KEYS, "frame", geometry.ear_suspicious(F.col("ear_valid"), F.col("yaw")).alias("ear_suspicious"))


def iris_sql(ring: int, eye: int, name: str) -> str:
    ring_x = " + ".join(d(ring + 2 * i) for i in range(4))
    ring_y = " + ".join(d(ring + 2 * i + 1) for i in range(4))
    p = [(d(eye + 2 * i), d(eye + 2 * i + 1)) for i in range(6)]
    swap = f"{p[0][0]} <= {p[3][0]}"
    return f"""SELECT vec_id, CASE WHEN hx*hx + hy*hy >= 1e-6 AND vx*vx + vy*vy >= 1e-6 THEN ((cx - lx)*hx + (cy - ly)*hy) / (hx*hx + hy*hy) END AS {name}_x,
  CASE WHEN hx*hx + hy*hy >= 1e-6 AND vx*vx + vy*vy >= 1e-6 THEN ((cx - ux)*vx + (cy - uy)*vy) / (vx*vx + vy*vy) END AS {name}_y
FROM (SELECT *, rx - lx AS hx, ry - ly AS hy, wx - ux AS vx, wy - uy AS vy FROM (SELECT vec_id,
  ({ring_x}) / 4 AS cx, ({ring_y}) / 4 AS cy,
  CASE WHEN {swap} THEN {p[0][0]} ELSE {p[3][0]} END AS lx, CASE WHEN {swap} THEN {p[0][1]} ELSE {p[3][1]} END AS ly,
  CASE WHEN {swap} THEN {p[3][0]} ELSE {p[0][0]} END AS rx, CASE WHEN {swap} THEN {p[3][1]} ELSE {p[0][1]} END AS ry,
  ({p[1][0]} + {p[2][0]}) / 2 AS ux, ({p[1][1]} + {p[2][1]}) / 2 AS uy,
  ({p[4][0]} + {p[5][0]}) / 2 AS wx, ({p[4][1]} + {p[5][1]}) / 2 AS wy FROM embeddings))"""


@query("iris_normalize", f"""SELECT vec_id, {shown('left_x', 'left_y')}, round((left_x + right_x) / 2 + 3e-9, 7) AS iris_x_norm,
  round((left_y + right_y) / 2 + 3e-9, 7) AS iris_y_norm
FROM ({iris_sql(24, 0, 'left')}) JOIN ({iris_sql(32, 12, 'right')}) USING (vec_id)""")
def _(x):
    ring = lambda at: geometry.ring_center(F.array(*[F.struct(v(at + 2 * i).alias("x"), v(at + 2 * i + 1).alias("y"))
                                                     for i in range(4)]))
    eyes = x.table("embeddings").select("vec_id", geometry.iris_position(ring(24), points(0)).alias("l"),
                                        geometry.iris_position(ring(32), points(12)).alias("r"))
    both = geometry.combined_iris(F.col("l"), F.col("r"))
    return eyes.select("vec_id", F.col("l.x").alias("left_x"), F.col("l.y").alias("left_y"),
                       both["x"].alias("iris_x_norm"), both["y"].alias("iris_y_norm"))


@query("stride_sample", sql(f"""SELECT 'gaze' AS kind, {K}, frame FROM frames WHERE frame % 3 = 0
UNION ALL SELECT 'features', {K}, frame FROM frames WHERE (frame - 1) % 3 = 0""", "frames"))
def _(x):
    kinds = F.array_compact(F.array(F.when(geometry.stride_flag(F.col("frame"), 3), "gaze"),
                                    F.when(geometry.stride_flag(F.col("frame"), 3, 1), "features")))
    return x.frames().select(F.explode(kinds).alias("kind"), *KEYS, "frame")
