import random

import pytest

from skyweave.sources import files, ordered, reports


def test_files_by_name_are_one_order(spark, tmp_path):
    """A third of the rows has one key, some have none."""
    rng = random.Random(3)
    keys = [7.0 if rng.random() < 0.33 else None if rng.random() < 0.05 else rng.uniform(0, 100) for _ in range(6000)]
    rows = spark.createDataFrame([(k, rng.choice("abc"), n) for n, k in enumerate(keys)], "timestamp double, uav_id string, _number0 int")
    path = f"file://{tmp_path}/t"
    ordered.write_sorted(rows, path, files=20)
    names = sorted(p.name for p in (tmp_path / "t").glob("part-*"))
    read = [r for n in names for r in spark.read.parquet(f"{path}/{n}").collect()]
    key = lambda r: (r.timestamp is not None, r.timestamp or 0, r.uav_id)
    assert len(names) == 20 and sorted(r[2] for r in read) == list(range(6000)) and [key(r) for r in read] == sorted(map(key, read))
    assert all(a[2] < b[2] for a, b in zip(read, read[1:], strict=False) if key(a) == key(b))
    sizes = [r.rows for r in spark.read.parquet(f"{path}/_index").collect()]
    assert max(sizes) < 3 * 6000 / 20  # the frequent key is several files
    got = ordered.read_range(spark, path, "timestamp", 40.0, 41.0, place="at").collect()
    assert {(r["_number0"], r["at"]) for r in got} == {(r[2], n) for n, r in enumerate(read) if r[0] is not None and 40 <= r[0] <= 41} and got
    assert len(ordered.files_of(spark, path, 40.0, 41.0)) <= 2 and ordered.read_range(spark, path, "timestamp", 200.0, 300.0).count() == 0


def test_an_empty_table_and_too_many_files(spark, tmp_path):
    empty = spark.createDataFrame([], "timestamp double, uav_id string")
    ordered.write_sorted(empty, f"file://{tmp_path}/e", files=3)
    assert ordered.read_range(spark, f"file://{tmp_path}/e", "timestamp", 0.0, 1.0, "at").count() == 0
    with pytest.raises(ValueError, match="99999"):
        ordered.write_sorted(empty, f"file://{tmp_path}/e", files=100_000)


def test_a_limit_takes_the_first_lines_of_each_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in "ab":
        (tmp_path / "d" / f"{name}.jsonl").write_text("".join("\n" if n % 5 == 0 else f'{{"k": "{name}{n}"}}\n' for n in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.read_jsonl(spark, f"file://{tmp_path}/d", "k string", limit=333)
        assert spark.read.text(f"file://{tmp_path}/d").rdd.getNumPartitions() > 10
        assert sorted(r.k for r in rows.collect()) == sorted(f"{name}{n}" for name in "ab" for n in range(333) if n % 5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evaluation_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0, 5), ("b", None, 6), ("c", 3.0, 7), ("d", 3.0, 8)], "uav_id string, rmse double, other int")
    for _ in range(2):
        reports.write_evaluation(rows, f"file://{tmp_path}/e", worst=3)
    read = lambda name: [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/e/{name}").collect()]
    assert read("worst") == [("c", "3.0", "7"), ("d", "3.0", "8"), ("a", "1.0", "5")] and len(read("rows")) == 4
    assert [(m, float(a), float(b)) for m, a, b, _ in read("summary")] == [("rmse", pytest.approx(7 / 3), 3.0)]


def test_results_are_numbers_in_order_of_time(spark, tmp_path):
    rows = spark.createDataFrame([("2", "1.5", None, 4), ("1", "x", "2", 5)], "timestamp string, lat string, lon string, alt int").withColumn("more", reports.F.lit(1))
    reports.write_results(rows, f"file://{tmp_path}/r")
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text == '{"timestamp":1.0,"lat":null,"lon":2.0,"alt":5.0}\n{"timestamp":2.0,"lat":1.5,"lon":null,"alt":4.0}\n'
