import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyweave.streaming import streams


def test_state_goes_on_between_batches(spark, tmp_path):
    values = [(k, t, (t * 37 + k * 11) % 100 / 100) for k in range(5) for t in range(30)]
    for part in range(3):
        pd.DataFrame([v for v in values if v[1] // 10 == part], columns=["k", "t", "q"]).to_parquet(tmp_path / f"part-{part}.parquet")
        import os

        os.utime(tmp_path / f"part-{part}.parquet", (1_700_000_000 + part, 1_700_000_000 + part))
    stream = spark.readStream.schema("k long, t long, q double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    got = {(r.k, r.t): (r.tau, r.votes) for r in streams.run(streams.thresholds(stream, "k", ["t"], "q"), "test-thresholds").collect()}
    assert len(got) == 150
    for k in range(5):
        tau, votes = 0.5, 0
        for _, t, q in [v for v in values if v[0] == k]:
            tau, votes = 0.8 * tau + 0.2 * q, votes + (q > 0.9)
            assert got[k, t] == (pytest.approx(tau), votes)


def test_alignment_by_batches_is_that_of_the_whole(spark, tmp_path):
    from skyweave.operators import asof

    truth = spark.createDataFrame([(k, t * 100, float(t)) for k in range(3) for t in range(20)], "k long, t long, v double")
    rows = [(k, t * 7) for k in range(3) for t in range(300)]
    for part in range(4):
        pd.DataFrame(rows[part::4], columns=["k", "t"]).to_parquet(tmp_path / f"part-{part}.parquet")
    stream = spark.readStream.schema("k long, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    found = sorted(map(tuple, streams.aligned(stream, truth, "k", "t", ["v"], 30, "test-aligned").collect()))
    whole = spark.createDataFrame(rows, "k long, t long")
    assert found == sorted(map(tuple, asof.nearest(whole, truth, "k", "t", ["v"], 30).collect())) and found


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    rows = pd.DataFrame({"id": [1, 1, 2, 3, 3], "ts": pd.to_datetime(["2024-01-01"] * 5)})
    rows.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "a.parquet")
    stream = spark.readStream.schema("id long, ts timestamp_ntz").parquet(f"{tmp_path}/*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.id for r in streams.run(streams.distinct_events(stream, "ts", "1 hour", "id"), "test-distinct").collect()) == [1, 2, 3]
