import tempfile
import types

import pytest

from skyweave.sources import files, shared


def test_csv_by_name_with_nan_blanks_and_aliases(spark, tmp_path):
    (tmp_path / "gps.csv").write_text("id,timestamp,lat,Nsat,RTK,extra\nu1,1.5,NaN,12,FIX,x\nu2,,45.1,odd,,y\n")
    rows = files.read_csv(spark, f"file://{tmp_path}/gps.csv", "gps").orderBy("uav_id").collect()
    assert [(r.uav_id, r.timestamp, r.lat, r.Nsat, r.RTK, r.DOP) for r in rows] == [("u1", 1.5, None, 12, "FIX", None), ("u2", None, 45.1, None, None, None)]


def test_each_csv_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("timestamp,uav_id,lat,lon\n1,u1,45.0,5.0\n")
    (tmp_path / "d" / "b.csv").write_text("uav_id,lon,lat,timestamp,more\nu2,6.0,46.0,2,x\nu3,7.0,47.0,3,y\n")
    (tmp_path / "d" / "c.csv").write_text("id,lat\nu4,48.0\n")
    (tmp_path / "d" / "d.csv").write_text("id,uav_id,lat,lat\nother,u5,49.0,50.0\n")
    (tmp_path / "d" / "empty.csv").write_text("")
    (tmp_path / "d" / "only.csv").write_text("uav_id,lat\n")
    want = [("u1", 1.0, 45.0, 5.0), ("u2", 2.0, 46.0, 6.0), ("u3", 3.0, 47.0, 7.0), ("u4", None, 48.0, None), ("u5", None, 49.0, None)]
    for path in (f"file://{tmp_path}/d", f"file://{tmp_path}/d/*.csv", [f"file://{tmp_path}/d/{n}.csv" for n in ("a", "b", "c", "d", "empty", "none")]):
        rows = files.read_csv(spark, path, "truth").orderBy("uav_id").collect()
        assert [(r.uav_id, r.timestamp, r.lat, r.lon) for r in rows] == want


def test_an_absent_csv_is_empty(spark, tmp_path):
    rows = files.read_csv(spark, f"file://{tmp_path}/none.csv", "gps")
    assert rows.count() == 0 and rows.columns[:2] == ["timestamp", "uav_id"] and "RTK" in rows.columns


def test_tracks_are_written_by_batch(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 2.0, "u"), ("b1", 1.0, "u"), ("b2", 1.0, "v")], "batch string, timestamp double, uav_id string").coalesce(1)
    for _ in range(2):
        files.write_tracks(rows, f"file://{tmp_path}/t")
    files.write_tracks(rows.where("batch = 'b2'").withColumn("batch", rows.uav_id), f"file://{tmp_path}/t")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["batch=b1", "batch=b2", "batch=v"]
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/t").count() == 4


def test_batches_of_lines_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    for batch in ("1", "2", "1"):
        files.write_jsonl(rows, f"file://{tmp_path}/l", batch)
    assert spark.read.text(f"file://{tmp_path}/l").count() == 2


def test_a_limit_counts_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n{"k": 3}\n')
    assert [r.k for r in files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "k int", limit=3).orderBy("_line").collect()] == [1, 2]


def test_json_keeps_nulls_and_nesting(spark, tmp_path):
    files.write_json(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b, struct('理' AS c) AS d"), f"file://{tmp_path}/j")
    assert [p.read_text() for p in (tmp_path / "j").glob("part-*")] == ['{"a":1,"b":null,"d":{"c":"理"}}\n']


def test_jsonl_round_trip_with_blank_and_broken_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", "理由"), ("b", None)], "sample_id string, answer string").coalesce(1)
    files.write_jsonl(rows, f"file://{tmp_path}/o", "1")
    assert "理由" in "".join(p.read_text() for p in (tmp_path / "o").rglob("part-*"))
    (tmp_path / "x.jsonl").write_text('{"sample_id": "a", "answer": "1"}\n\n{broken\n{"sample_id": "a", "answer": "2"}\n')
    read = files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "sample_id string, answer string").orderBy("_line").collect()
    assert [(r.sample_id, r.answer) for r in read] == [("a", "1"), (None, None), ("a", "2")]


def test_modality_names(spark):
    names = ["5G", " 5g_a ", "5GA", "fiveg", "GPS", None]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    assert [r[0] for r in df.select(files.modality_key(df.k)).collect()] == ["fiveg"] * 4 + ["gps", None]


def test_profiles_override_the_base():
    text = '{"base_override": {"a": {"x": 1, "y": [1, 2]}, "b": 1}, "profiles": [{"name": "p", "override": {"a": {"y": [3]}}}, {"name": "q"}]}'
    assert dict(files.profiles(text)) == {"p": {"a": {"x": 1, "y": [3]}, "b": 1}, "q": {"a": {"x": 1, "y": [1, 2]}, "b": 1}}


def test_scratch_is_one_folder_of_the_application(spark):
    a, b = (shared.scratch_path(spark, "x") for _ in range(2))
    assert a != b and a.startswith(f"{shared.shared_dir(spark)}/run-{spark.sparkContext.applicationId}/")
    other = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    fake = types.SimpleNamespace(sparkContext=types.SimpleNamespace(master="spark://host:7077", getConf=lambda: {}))
    with pytest.raises(ValueError, match="all executors share"):
        shared.shared_dir(fake)
    fake.sparkContext.getConf = lambda: {"spark.checkpoint.dir": f"file://{other}/"}
    assert shared.shared_dir(fake) == f"file://{other}"
