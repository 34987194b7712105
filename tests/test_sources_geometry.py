"""Files, names and landmark geometry."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framelens.config import FRAME_COLUMNS, GAZE_COLUMNS, LABELS
from framelens.functions import geometry, naming
from framelens.operators import clean, features, scoring
from framelens.operators.series import Series
from framelens.sources import files, listing
from tests.helpers import rows


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def frame_file(sep, columns=FRAME_COLUMNS, n=3, bad=""):
    value = {"frame": lambda i: str(i), "time_sec": lambda i: f"{i / 30:.6f}"}
    lines = [sep.join(f' "{c}"' if c == "yaw" else c for c in columns)]
    lines += [sep.join(value.get(c, lambda i: bad if c == "yaw" and bad else "0.5")(i) for c in columns) for i in range(1, n + 1)]
    return "\n".join(lines) + "\n"


def test_frames_from_mixed_files(spark, tmp_path):
    put(tmp_path / "normal/IR/a+b;1.csv", "﻿" + frame_file(";"))
    put(tmp_path / "drowsiness/RGB/clip 2.csv", frame_file(",", tuple(reversed(FRAME_COLUMNS)), bad="n/a"))
    put(tmp_path / "drowsiness/RGB/sub/deep.csv", frame_file(";", tuple(c for c in FRAME_COLUMNS if c != "ear_suspicious")))
    put(tmp_path / "drowsiness/RGB/short.csv", frame_file(";", ("frame", "yaw")))
    put(tmp_path / "drowsiness/RGB/~$temp.csv", frame_file(";"))
    put(tmp_path / "other/RGB/x.csv", frame_file(";"))
    put(tmp_path / "loose.csv", frame_file(";"))
    good, errors = files.read_frames(spark, str(tmp_path))
    got = {(r["label"], r["modality"], r["file_stem"], r["n"], r["y"], r["s"]) for r in good.groupBy("label", "modality", "file_stem").agg(
        F.count(F.lit(1)).alias("n"), F.count("yaw").alias("y"), F.count("ear_suspicious").alias("s")).collect()}
    assert got == {("normal", "IR", "a+b;1", 3, 3, 3), ("drowsiness", "RGB", "clip 2", 3, 0, 3), ("drowsiness", "RGB", "deep", 3, 3, 0)}
    reasons = {r["path"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()}
    assert reasons["x.csv"] == "unknown label" and reasons["loose.csv"] == "unexpected path structure"
    assert reasons["short.csv"].startswith("missing columns: time_sec") and len(reasons) == 3


def test_quoted_fields_may_hold_the_separator(spark):
    lines = ['1;"a;b";"say ""x"" ;";', ';"";2; "q" ;z"z', '"open;3', '', '"1"x;2']
    got = [r[0] for r in spark.createDataFrame([(v,) for v in lines], "v string").select(files.cells(F.col("v"), ";")).collect()]
    assert got == [["1", "a;b", 'say "x" ;', ""], ["", "", "2", "q", 'z"z'], ['"open', "3"], [""], ['"1"x', "2"]]


def test_frames_from_columnar_files(spark, tmp_path):
    kinds = {"frame": "long", "note": "string"}
    full = [*FRAME_COLUMNS, "note"]
    make = lambda cols, data: spark.createDataFrame(data, ", ".join(f"`{c}` {kinds.get(c.strip(), 'double')}" for c in cols))
    rows_ = [tuple(i if c == "frame" else "x" if c == "note" else float("nan") if c == "yaw" and i == 2 else 0.5 for c in full) for i in (1, 2, 3)]
    def save(df, place):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        df.toPandas().to_parquet(tmp_path / place)
    save(make(full, rows_), "normal/IR/a.parquet")
    save(make([" pitch " if c == "pitch" else c for c in full], rows_), "normal/IR/padded.parquet")
    save(make(["frame", "yaw"], [(1, 0.5)]), "drowsiness/RGB/short.parquet")
    save(make(full, rows_).limit(0), "drowsiness/RGB/empty.parquet")
    save(make(full, rows_), "other/RGB/x.parquet")
    good, errors = files.read_frames(spark, str(tmp_path), "*.parquet")
    got = {r["file_stem"]: (r["n"], r["y"]) for r in good.groupBy("file_stem").agg(F.count("frame").alias("n"), F.count("yaw").alias("y")).collect()}
    assert got["a"] == (3, 2)
    reasons = {r["path"].rsplit("/", 1)[1]: r["error"] for r in errors.collect()}
    assert reasons["short.parquet"].startswith("missing columns: time_sec") and reasons["empty.parquet"] == "no rows" and reasons["x.parquet"] == "unknown label"
    none = files.read_frames(spark, str(tmp_path / "normal"), "*.none.parquet")
    assert none[0].count() == none[1].count() == 0


def test_runs_are_stored_once_and_read_newest_first(spark, tmp_path):
    from framelens.sources import run_store

    keys, at = ("label", "modality", "file_stem"), [datetime(2024, 1, d) for d in (1, 2, 3)]
    p = spark.createDataFrame([("normal", "IR", n, w, 0.0, 3.0, "normal", 0.7, 0.2, 0.1, 30.0, 5.0, 0.3, 9.0, 1) for n in "abc" for w in (1, 2)],
                              "label string, modality string, file_stem string, window_id int, window_start_time double, window_end_time double, "
                              "predicted_label string, prob_normal double, prob_drowsiness double, prob_distraction double, window_risk_score double, "
                              "perclos_percent double, mean_ear double, max_abs_yaw double, is_usable int")
    v = scoring.stream_verdict(p, keys)
    q = v.select(*keys).withColumns({c: F.lit(1.0) for c in ("total_frames", "detected_face_ratio", "valid_pose_ratio", "valid_ear_ratio", "suspicious_ear_ratio", "valid_frame_count")})
    for moment in (at[0], at[2], at[1], at[0]):  # late and repeated
        run_store.store_runs(str(tmp_path), v, q, p, keys, model_key="m", feature_set="baseline", created_at=moment)
    assert run_store.batches(spark, str(tmp_path)) == ["20240103_000000", "20240102_000000", "20240101_000000"]
    runs = run_store.stored(spark, str(tmp_path))
    assert runs.count() == 9 and runs.select("id").distinct().count() == 9 and len(runs.drop("batch").columns) == 21
    newest = run_store.newest_runs(spark, str(tmp_path), 4)
    assert [r["created_at"].day for r in newest.collect()] == [3, 3, 3, 2]
    scan = run_store.stored(spark, str(tmp_path), only=["20240103_000000"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [batch" in scan.replace("isnotnull(batch#", "[batch#").replace("[[", "[")
    first = newest.first()
    assert [r["window_id"] for r in run_store.windows_of(spark, str(tmp_path), first["id"], "20240103_000000").collect()] == [1, 2]


def test_ordinal_follows_the_file(spark, tmp_path):
    put(tmp_path / "normal/IR/a.csv", frame_file(";", n=50))
    good, _ = files.read_frames(spark, str(tmp_path))
    assert [r["frame"] for r in good.orderBy("ordinal").collect()] == list(range(1, 51))


def test_gaze_files(spark, tmp_path):
    put(tmp_path / "normal/IR/c1_pymovements_input.csv", frame_file(",", GAZE_COLUMNS))
    put(tmp_path / "normal/IR/c2_pymovements_input.csv", frame_file(",", ("frame", "time_sec", "face_detected", "iris_x_norm", "iris_y_norm")))
    good, errors = files.read_gaze(spark, str(tmp_path))
    assert {r[0] for r in good.select("file_stem").distinct().collect()} == {"c1", "c2"} and errors.count() == 0
    strict, errors = files.read_gaze(spark, str(tmp_path), strict=True)
    assert {r[0] for r in strict.select("file_stem").distinct().collect()} == {"c1"} and errors.count() == 1


def test_clean_header(spark):
    df = spark.createDataFrame([(1, 2)], [' "frame" ', "'yaw'"])
    assert files.clean_header(df).columns == ["frame", "yaw"]


@pytest.mark.parametrize("s", [Series(chunk_rows=None), Series(chunk_rows=2)])
def test_output_per_series(spark, tmp_path, s):
    df = spark.createDataFrame([("normal", "IR", "a", i) for i in range(5)] + [("normal", "RGB", "b", 1)], "label string, modality string, file_stem string, frame long")
    files.write_per_stream(df, str(tmp_path / "out"), s)
    assert (tmp_path / "out/label=normal/modality=IR/file_stem=a").is_dir()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*df.columns)) == rows(df)


def test_versions(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    files.write_versioned(one, str(tmp_path), "t", datetime(2024, 1, 1))
    files.write_versioned(two, str(tmp_path), "t", datetime(2024, 1, 2))
    assert files.read_latest(spark, str(tmp_path), "t").count() == 2
    with pytest.raises(Exception):
        files.write_versioned(one, str(tmp_path), "t", datetime(2024, 1, 2))


def test_run_tables(spark, tmp_path):
    p = spark.createDataFrame([("normal", "IR", "a", 1, 0.0, 3.0, "normal", None, 0.2, 0.1, 30.0, 5.0, 0.3, 9.0, 1)],
                              "label string, modality string, file_stem string, window_id int, window_start_time double, window_end_time double, "
                              "predicted_label string, prob_normal double, prob_drowsiness double, prob_distraction double, window_risk_score double, "
                              "perclos_percent double, mean_ear double, max_abs_yaw double, is_usable int")
    keys = ("label", "modality", "file_stem")
    v = scoring.stream_verdict(p.fillna(0.7), keys)
    q = v.select(*keys).withColumns({c: F.lit(None).cast("double") for c in ("total_frames", "detected_face_ratio", "valid_pose_ratio", "valid_ear_ratio", "suspicious_ear_ratio", "valid_frame_count")})
    for day in (1, 2):
        at = F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00"))
        scoring.append_table(scoring.run_rows(v, q, keys, model_key="m", feature_set="baseline", created_at=at), str(tmp_path / "runs"))
        scoring.append_table(scoring.prediction_rows(p, keys, created_at=at), str(tmp_path / "windows"))
    runs, windows = spark.read.parquet(str(tmp_path / "runs")), spark.read.parquet(str(tmp_path / "windows"))
    assert windows.join(runs, windows.analysis_id == runs.id).count() == 2
    assert windows.first()["prob_normal"] == 0.0 and runs.first()["total_frames"] == 0
    recent = scoring.recent_runs(runs, 1).first()
    assert str(recent["created_at"]).startswith("2024-01-02") and len(scoring.recent_runs(runs).columns) == 9
    assert len(runs.columns) == 21 and len(windows.columns) == 14


def test_names(spark):
    df = spark.createDataFrame([("My_DROWSINESS_normal",), ("uyku1",), ("dikkat",), ("direction",), ("x",)], "n string")
    got = [(r[0], r[1], r[2]) for r in df.select(naming.label_of(F.col("n")), naming.modality_of(F.col("n")), naming.source_group_of(F.col("n"))).collect()]
    assert got == [("normal", "RGB", "unknown"), ("drowsiness", "RGB", "unknown"), ("distraction", "RGB", "unknown"),
                   ("uploaded", "IR", "unknown"), ("uploaded", "RGB", "unknown")]


def test_unique_sources_prefers_keyword_then_length(spark):
    df = spark.createDataFrame([("/z/Face/v.mp4",), ("/a/V.mp4",), ("/b/w.mp4",), ("/a/w.mp4",)], "path string")
    assert rows(listing.unique_sources(df, "face")) == [("v.mp4", "/z/Face/v.mp4"), ("w.mp4", "/a/w.mp4")]
    assert listing.limit_streams(df, ("path",), 0).count() == 4


def point(x, y):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_eye_aspect_ratio(spark):
    eye = [point(*p) for p in ((0, 0), (1, 1), (3, 1), (4, 0), (3, -1), (1, -1))]
    assert one(spark, geometry.eye_aspect_ratio(eye, F.lit(2.0))) == 0.5
    assert one(spark, geometry.eye_aspect_ratio(eye, F.lit(4.1))) is None
    assert one(spark, geometry.min_eye_width(F.lit(1000.0))) == 5.0 and one(spark, geometry.min_eye_width(F.lit(100.0))) == 2.0
    assert one(spark, geometry.average_ear(F.lit(0.2), F.lit(None).cast("double"))) is None


def test_euler_angles(spark):
    a = math.radians(30)
    yaw = [[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]]
    lit = lambda m: [[F.lit(float(v)) for v in r] for r in m]
    got = {k: one(spark, c) for k, c in geometry.euler_angles(lit(yaw)).items()}
    assert got["yaw"] == pytest.approx(30) and got["pitch"] == pytest.approx(0) and got["roll"] == pytest.approx(0)
    singular = {k: one(spark, c) for k, c in geometry.euler_angles(lit([[0, 0, 1], [0, 1, 0], [-1, 0, 0]])).items()}
    assert singular["yaw"] == pytest.approx(90) and singular["roll"] == 0.0


@pytest.mark.parametrize("angles,want", [((100, 10, 0), (80, -170, -180)), ((-100, 0, 0), (-80, -180, -180)), ((200, 190, 540), (-20, 10, 0)), ((45, 180, 0), (45, -180, 0))])
def test_normalize_angles(spark, angles, want):
    got = geometry.normalize_angles(*[F.lit(float(a)) for a in angles])
    assert tuple(round(one(spark, c), 9) for c in got.values()) == want


def test_pose_and_suspicion(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geometry.pose_valid(*lit(60, -90, 50, 12))) == 1 and one(spark, geometry.pose_valid(*lit(60.1, 0, 0, 0))) == 0
    assert one(spark, geometry.pose_valid(F.lit(None).cast("double"), *lit(0, 0, 0))) == 0
    assert one(spark, geometry.ear_suspicious(F.lit(1), F.lit(None).cast("double"))) == 1
    assert one(spark, geometry.ear_suspicious(F.lit(0), F.lit(80.0))) == 0 and one(spark, geometry.ear_suspicious(F.lit(1), F.lit(35.0))) == 0


def test_iris_position_is_independent_of_corner_order(spark):
    eye = ((0, 0), (1, 1), (3, 1), (4, 0), (3, 3), (1, 3))
    forward = [point(*p) for p in eye]
    swapped = [point(*eye[3]), *[point(*p) for p in eye[1:3]], point(*eye[0]), *[point(*p) for p in eye[4:]]]
    ring = geometry.ring_center(F.array(point(1, 2), point(3, 2)))
    for points in (forward, swapped):
        got = one(spark, geometry.iris_position(ring, points))
        assert (got["x"], got["y"]) == (0.5, 0.5)
    assert one(spark, geometry.iris_position(ring, [point(0, 0)] * 6)) is None


def test_strides(spark):
    frames = spark.range(1, 8)
    assert [r[0] for r in frames.filter(geometry.stride_flag(F.col("id"), 3)).collect()] == [3, 6]
    assert [r[0] for r in frames.filter(geometry.stride_flag(F.col("id"), 3, 1)).collect()] == [1, 4, 7]


def test_extraction_quality(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 0)], "face_detected int, pose_valid int, ear_suspicious int")
    assert rows(features.extraction_quality(df, ())) == [(25.0, 25.0, 25.0)]


def test_align_union(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "q")], "x int, y string")
    assert rows(clean.align_union([a, b])) == [(1, None), (2, "q")]
    assert LABELS[0] == "normal"


def test_errors_come_from_the_files_table_and_agreeing_files_are_read_as_a_folder(spark, tmp_path, monkeypatch):
    row, place = {c: 1.0 for c in FRAME_COLUMNS} | {"frame": 1}, tmp_path / "normal/IR"
    place.mkdir(parents=True)
    for i in range(3):
        spark.createDataFrame([row | {"avg_ear": i / 10}]).toPandas().to_parquet(place / f"s{i}.parquet")
    monkeypatch.setattr(files, "_one_schema", lambda *a: pytest.fail("files named one by one"))
    good, errors = files.read_frames(spark, str(tmp_path), "*.parquet")
    assert sorted(r["file_stem"] for r in good.collect()) == ["s0", "s1", "s2"] and errors.isEmpty()
    assert not [f for f in errors.inputFiles() if "/normal/" in f]  # the rows are not read again for them


def test_few_rows_of_many_series_are_written_by_several_tasks(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", i) for i in range(40)], "id string, frame long")
    files.write_per_stream(df, str(tmp_path / "out"), Series(("id",), "frame", None))
    assert len({p.name.split("-")[1] for p in (tmp_path / "out").glob("*/part-*")}) > 1
    assert len(list((tmp_path / "out").glob("id=*/part-*"))) == 40 == spark.read.parquet(str(tmp_path / "out")).count()


def mixed_tree(place):
    put(place / "normal/IR/a+b;1.csv", "﻿" + frame_file(";"))
    put(place / "normal/IR/100%41 {x}.csv", frame_file(";", n=9).replace("0.5", '"0.25"'))
    put(place / "drowsiness/RGB/clip 2.csv", frame_file(",", tuple(reversed(FRAME_COLUMNS)), bad="NaN").replace("\n", "\r\n"))
    put(place / "drowsiness/RGB/short.csv", frame_file(";", ("frame", "yaw")))
    put(place / "drowsiness/RGB/empty.csv", "")
    put(place / "drowsiness/RGB/head.csv", frame_file(";", n=0))
    put(place / "drowsiness/RGB/~$temp.csv", frame_file(";"))
    put(place / "drowsiness/RGB/_hidden.csv", frame_file(";"))
    put(place / "other/RGB/x.csv", frame_file(";"))
    put(place / "drowsiness/RGB/note.txt", "frame\n1\n")


def test_tasks_and_sources_read_text_alike(spark, tmp_path, monkeypatch):
    mixed_tree(tmp_path)
    read = lambda: [rows(df) for df in files.read_frames(spark, str(tmp_path))]
    good, errors = read()
    assert len(good) == 15
    assert sorted(r[1] for r in errors) == sorted(["no rows", "no rows", "unknown label", next(r[1] for r in errors if "short" in r[0])])
    for most in (400, -1):  # some files, then all of them by Spark's source; its ordinals are others
        monkeypatch.setattr(files.tree, "SMALL", most)
        drop = lambda table: sorted(tuple(v for i, v in enumerate(r) if i != at) for r in table)
        at = files.read_frames(spark, str(tmp_path))[0].columns.index("ordinal")
        assert [drop(good), errors] == [drop(read()[0]), read()[1]]


def test_tasks_and_sources_read_columns_alike(spark, tmp_path, monkeypatch):
    import pandas as pd

    full = pd.DataFrame({c: [1, 2, 3] if c == "frame" else [0.5, float("nan"), None] for c in FRAME_COLUMNS})
    odd = {"plain": full, "padded": full.rename(columns={"pitch": " pitch "}), "bytes": full.assign(face_detected=[1, 0, 1]),
           "text": full.assign(yaw=["1.5", "x", None]), "half": full.astype({"roll": "float32"}), "short": full[["frame", "yaw"]],
           "void": full.assign(yaw=float("nan")), "none": full[:0]}
    for name, table in odd.items():
        place = tmp_path / f"normal/IR/{name}.parquet"
        place.parent.mkdir(parents=True, exist_ok=True)
        table.to_parquet(place)
    read = lambda: [rows(df) for df in files.read_frames(spark, str(tmp_path), "*.parquet")]
    tasks = read()
    assert len(tasks[0]) == 15 and sorted(r[1].split(":")[0] for r in tasks[1]) == ["missing columns", "missing columns", "no rows"]
    monkeypatch.setattr(files.tree, "SMALL", -1)
    assert tasks == read()


def test_the_driver_lists_no_files_of_series(spark, tmp_path, monkeypatch):
    put(tmp_path / "normal/IR/a.csv", frame_file(";"))
    df = spark.createDataFrame([("normal", "IR", "a", 1)], "label string, modality string, file_stem string, frame long")
    for name in ("_listing", "_text", "_stored"):
        monkeypatch.setattr(files, name, lambda *a: pytest.fail("a listing of Spark's source"))
    assert files.read_frames(spark, str(tmp_path))[0].count() == 3
    files.write_per_stream(df, str(tmp_path / "out"))
    back = files.read_per_stream(spark, str(tmp_path / "out"), df.schema)
    assert rows(back) == rows(df) and not [f for f in back.inputFiles() if "/out/" in f]


def test_cells_are_the_same_in_tasks(spark):
    lines = ['1;"a;b";"say ""x"" ;";', ';"";2; "q" ;z"z', '"open;3', '"1"x;2', '"a";"b;c";""', "1;;3", '"', '""', 'x;"', '"a" ;"b"', '"a"";"b"']
    got = [r[0] for r in spark.createDataFrame([(v,) for v in lines], "v string").coalesce(1).select(files.cells(F.col("v"), ";")).collect()]
    assert got == [files.tree.cells(v, ";") for v in lines]


def test_series_folders_of_odd_names_are_those_of_sparks_writer(spark, tmp_path):
    names = ["a b", "50%", "x=y/z", "", None, "é", "q'\"[1]"]
    df = spark.createDataFrame([("normal", n, float(i), i) for i, n in enumerate(names)] * 2, "label string, file_stem string, v double, frame long")
    s = Series(("label", "file_stem"), "frame", None)
    df.write.partitionBy(*s.keys).parquet(str(tmp_path / "spark"))
    for mode in ("overwrite", "overwrite", "append", "ignore"):
        files.write_per_stream(df, str(tmp_path / "tasks"), s, mode)
    folders = lambda p: sorted(str(f.relative_to(p)) for f in p.glob("*/*") if f.is_dir())
    assert folders(tmp_path / "spark") == folders(tmp_path / "tasks")
    want = sorted(rows(spark.read.schema(df.schema).parquet(str(tmp_path / "spark")).select(df.columns)) * 2, key=repr)
    assert rows(files.read_per_stream(spark, str(tmp_path / "tasks"), df.schema, s)) == want
    assert rows(spark.read.schema(df.schema).parquet(str(tmp_path / "tasks")).select(df.columns)) == want
    assert rows(files.read_per_stream(spark, str(tmp_path / "spark"), df.schema, s)) == rows(spark.read.schema(df.schema).parquet(str(tmp_path / "spark")).select(df.columns))
    with pytest.raises(ValueError):
        files.write_per_stream(df, str(tmp_path / "tasks"), s, "errorifexists")


def test_patterns_of_names():
    import re

    match = lambda glob, name: bool(re.fullmatch(files.tree.name_pattern(glob), name))
    assert match("*.csv", "a.b.csv") and not match("*.csv", "a.csvx") and match("{a,b}?.[ct]sv", "bx.tsv") and not match("[^a]*", "ab") and match(r"\*", "*")


@pytest.mark.parametrize("ending", ["csv", "parquet"])
def test_a_tree_holds_a_file_for_each_series_under_the_writers_names(spark, tmp_path, ending):
    from framelens.plans.source_queries import write_tree

    stems = ["a", "b/c", "d=e", None, ""]
    df = spark.createDataFrame([("normal", "IR", v, i, 0.5 * i) for i in range(3) for v in stems], "label string, modality string, file_stem string, frame long, v double")
    write_tree(df, str(tmp_path / "t"), ending)
    found = sorted(p.name for p in (tmp_path / "t/normal/IR").iterdir())
    assert found == sorted(f"{n}.{ending}" for n in ("a", "b%2Fc", "d%3De", "__HIVE_DEFAULT_PARTITION__"))
    back = files.read_tables(spark, str(tmp_path / "t"), ("frame", "v"), ("frame", "v"), f"*.{ending}")[0]
    assert rows(back.select("frame", "v")) == sorted((i, 0.5 * i) for i in range(3) for _ in "abc")
