import json

import pytest

from skyweave.sources import datasets

GPS = "timestamp,uav_id,lat,lon,alt,Nsat,DOP,RTK\n"
TRUTH = "timestamp,uav_id,lat,lon,alt\n0,u,45,5,100\n"


@pytest.fixture
def root(tmp_path):
    def put(name, text):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)

    put("b set/batch10/gps.csv", GPS + "0,u,45,5,100,20,0.5,FIX\n1,u,45,5,100,4,8,NONE\n")
    put("b set/batch10/truth.csv", TRUTH)
    put("b set/batch02/radar.csv", "uav_id,timestamp,E,Ptrk\nv,1,1,1\n")
    put("b set/batch03/notes.txt", "no sensor")
    put("b set/other/gps.csv", GPS)
    put("a/gps.csv", GPS + "0,w,45,5,100,12,NaN,FLOAT\n")
    put("a/truth.csv", TRUTH)
    put("c/gps.csv", GPS)  # no truth
    put("gps.csv", GPS)
    return tmp_path


def test_units_are_batches_or_flat(spark, root):
    found = datasets.units(spark, f"file://{root}/in")
    assert [(u.dataset, u.name) for u in found] == [("a", "flat"), ("b set", "batch02"), ("b set", "batch10")]
    assert datasets.units(spark, f"file://{root}/none") == []


def test_units_are_merged_to_batches(spark, root):
    for _ in range(2):
        summary = {(r.batch, r.source_dataset, r.source_unit, r.modality): (r.rows, r.mean) for r in datasets.convert(spark, f"file://{root}/in", f"file://{root}/out").collect()}
        assert summary == {("batch01", "a", "flat", "gps"): (1, pytest.approx(0.7 * 0.6 * 0.5 + 0.3 * 0.6)), ("batch02", "b set", "batch02", "radar"): (1, pytest.approx(1.0)), ("batch03", "b set", "batch10", "gps"): (2, pytest.approx((1.0 + 0.3 * 0.2) / 2))}
        out = spark.read.option("header", True).csv(f"file://{root}/out").groupBy("batch", "modality").count().collect()
        assert {(r.batch, r.modality): r["count"] for r in out} == {("batch01", "gps"): 1, ("batch01", "truth"): 1, ("batch02", "radar"): 1, ("batch03", "gps"): 2, ("batch03", "truth"): 1}
    lines = [json.loads(x) for p in (root / "out" / "_summary").glob("part-*") for x in p.read_text().splitlines()]
    assert {x["batch"]: [m["rows"] for m in x["modalities"]] for x in lines} == {"batch01": [1], "batch02": [1], "batch03": [2]}


def test_an_empty_root_has_no_batches(spark, root):
    assert datasets.convert(spark, f"file://{root}/none", f"file://{root}/empty").count() == 0


def test_a_table_is_built_once_for_a_signature(spark, root):
    made = []

    def table(**settings):
        key = datasets.signature(spark, f"file://{root}/in", **settings)
        return datasets.cached(spark, f"file://{root}/cache", key, lambda: made.append(key) or spark.range(3)).count()

    assert [table(window=20), table(window=20), table(window=10)] == [3, 3, 3] and len(made) == 2
    (root / "in" / "a" / "gps.csv").write_text(GPS)
    assert table(window=20) == 3 and len(made) == len(set(made)) == 3
