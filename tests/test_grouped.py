import json

import pytest
from pyspark.sql import functions as F

from skyweave.operators import labelling
from skyweave.sources import packets

def test_labelling_goes_on_where_it_was(spark):
    prompts = spark.createDataFrame([("1", "U1", "good"), ("2", "U1", "bad"), ("3", "U1", "broken"), ("4", "U1", "done")], "sample_id string, uav_id string, prompt string")
    done = spark.createDataFrame([("4", 1), ("2", 0)], "sample_id string, ok int")

    def client(text):
        if text == "broken":
            raise TimeoutError("late")
        return "U1，请悬停\n理由:ok" if text == "good" else "no"

    got = {r.sample_id: (r.ok, r.check, r.error, r.tries) for r in labelling.label_missing(prompts, done, client).collect()}
    assert got == {"1": (1, "ok", None, 1), "2": (0, "not_two_lines", None, 1), "3": (0, "failed", "TimeoutError: late", 4)}


def body(n, wrap=None, **first):
    rows = [{"timestamp": float(i), "gps": {"lat": 45.0, "lon": 5.0, "alt": 100.0, "Nsat": 15, "DOP": 1.4, "RTK": "FIX"}} for i in range(n)]
    rows[0] |= first
    return json.dumps({wrap: rows} if wrap else rows)


def test_packets_become_sensor_rows(spark):
    df = spark.createDataFrame([(1, body(20, "packets", uav_id="U7")), (2, body(20))], "request_id long, body string")
    rows = packets.sensor_rows(df).collect()
    assert len(rows) == 2 * 20 * 5 and {r.uav_id for r in rows} == {"U7", "UAV_HTTP"}
    gps = next(r for r in rows if r.modality == "gps" and r.request_id == 1 and r.i == 3)
    assert (gps.timestamp, gps.lat, gps.vx, gps.metrics["RTK"], float(gps.metrics["Nsat"])) == (3.0, 45.0, 0.0, "FIX", 15.0)
    radar = next(r for r in rows if r.modality == "radar")
    assert radar.lat is None and float(radar.metrics["E"]) == 0.0


def test_other_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, body(3)), (2, "nonsense")], "request_id long, body string")
    assert packets.sensor_rows(df.where("request_id = 1"), length=None).count() == 15
    for n in (1, 2):
        with pytest.raises(Exception, match="20 packets"):
            packets.sensor_rows(df.where(f"request_id = {n}")).collect()


def test_a_name_that_is_there_decides(spark):
    one = json.dumps([{"timestamp": 1.0}])
    bodies = [f'{{"data": null, "packets": {one}}}', f'{{"data": {{}}, "packets": {one}}}', f'{{"packets": {one}}}', f'{{"list": {one}, "packets": {one}}}', one, "{}", "1", None]
    df = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, body string")
    sizes = {r.n: r.k for r in df.selectExpr("n", "body").withColumn("k", F.size(packets.packets_of(F.col("body")))).collect()}
    assert [sizes[n] if sizes[n] not in (None, -1) else None for n in range(len(bodies))] == [None, None, 1, 1, 1, None, None, None]


def test_labelling_by_slices_stores_what_is_done(spark, tmp_path):
    prompts = spark.createDataFrame([(str(n), "U1", f"p{n}") for n in range(40)], "sample_id string, uav_id string, prompt string")
    path, log = f"file://{tmp_path}/labels", tmp_path / "calls"
    log.mkdir()

    def client(text):
        (log / text).write_text(str(int((log / text).read_text()) + 1) if (log / text).exists() else "1")
        if text == "p7" and not (log / "up").exists():
            raise TimeoutError("late")
        return "U1，请悬停\n理由:ok"

    first = {r.sample_id: (r.ok, r.tries) for r in labelling.label_in_slices(prompts, path, client, slices=4, tries=2, pause=0.01).collect()}
    assert len(first) == 40 and first["7"] == (0, 2) and sum(ok for ok, _ in first.values()) == 39
    (log / "up").touch()
    again = {r.sample_id: r.ok for r in labelling.label_in_slices(prompts, path, client, slices=4).collect()}
    assert sum(again.values()) == len(again) == 40
    assert (log / "p7").read_text() == "3" and all((log / f"p{n}").read_text() == "1" for n in range(40) if n != 7)


def test_names_of_customers_beyond_five_digits_are_as_in_sql(spark, tmp_path):
    import __spark_entry__ as entry

    from .oracle import compare, views

    shifted = {"orders": "* REPLACE (o_custkey + 99999 AS o_custkey)", "lineitem": "*"}
    con = views()
    for name, columns in shifted.items():
        con.execute(f"COPY (SELECT {columns} FROM {name} LIMIT 4000) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    for query in ("prompt_render", "prompt_with_place", "token_accounting", "answer_validate", "jsonl_last_wins"):
        assert not compare(entry.queries()[query](spark, str(tmp_path)), entry.oracle_sql()[query], con), query


def test_serve_tensor_has_every_step_that_three_sensors_share(spark):
    from skyweave.plans import catalog

    from .oracle import SMALL, views

    want = views().sql("SELECT sum(least(a, b, c)) FROM (SELECT count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'signup') AS b, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY user_id)").fetchall()[0][0]
    got = catalog.queries()["serve_tensor"](spark, SMALL)
    assert got.count() == want > 0
