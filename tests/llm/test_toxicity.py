import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyweave.llm import queries, toxicity
from tests.oracle import SMALL

from .cases import DOCS, documents, got


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_rows(spark):
    sf = SMALL.replace("0.001", "0.01")
    out = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(out) == docs and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in out and out[r.doc_id].held_out}
    y = np.array(list(labels.values()))
    p = np.array([out[i].score for i in labels])
    assert auc(p, y) > 0.95 and np.mean((p >= 0.5) == y) > 0.9


ROWS = [(i, ("awful vile slur " if i % 2 else "kind calm words ") + f"filler{i}", i % 2) for i in range(400)]


def small(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return toxicity.train(df, df, toxicity.Settings(l1=1.0))


def test_edge_rows(spark):
    scored = toxicity.score(documents(spark), small(spark))
    assert len(got(scored)) == len(DOCS) and all(0 <= r[-1] <= 1 for r in got(scored))
    assert toxicity.score(documents(spark, []), small(spark)).count() == 0
    assert scored.columns == [*(c for c in documents(spark).columns if c != "score"), "score"]


def test_separates_and_is_sparse(spark):
    model = small(spark)
    assert 0 < len(model.at) < 400
    texts = spark.createDataFrame([(1, "vile slur"), (2, "calm words"), (3, None)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert s[1] > 0.8 and s[2] < 0.2 and 0 <= s[3] <= 1


def test_no_rows_and_rows_without_label(spark):
    assert not len(small(spark, []).at)
    assert not len(small(spark, [(1, "a", None)]).at)


def test_bound_draws_about_as_many(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, label int")
    assert len(toxicity.train(df, df, toxicity.Settings(l1=1.0, max_rows=100, shard_rows=7)).at)


def test_training_is_repeatable(spark):
    a, b = small(spark), small(spark, ROWS[::-1])
    assert np.array_equal(a.at, b.at) and np.allclose(a.weights, b.weights)


def plain_features(text, bits):
    """The places of a text, n-gram by n-gram."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    h, m = [xxhash.xxh64_intdigest(w) for w in words], [int(x) for x in toxicity._MIX]
    grams = [*h, *((a * m[1] % 2**64) ^ (b * m[2] % 2**64) for a, b in zip(h, h[1:])), *((a * m[3] % 2**64) ^ (b * m[4] % 2**64) for a, b in zip(h, h[2:]))]
    return sorted({*((g * m[0] % 2**64) >> (64 - bits) for g in grams), 0})


@settings(deadline=None, max_examples=60)
@given(st.one_of(st.none(), st.text(alphabet="aB cé1-\n東", max_size=30)))
def test_features_are_what_a_plain_loop_gives(text):
    assert np.unique(toxicity.features(text, 12)).tolist() == plain_features(text, 12)


def plain_pass(rows, z, n, s):
    """FTRL-proximal weight by weight."""
    for at, label in rows:
        w = {}
        for i in at:
            w[i] = 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g


@pytest.mark.parametrize("shard_rows", [5000, 90])
def test_training_is_what_plain_loops_give(spark, shard_rows):
    """Every epoch from the mean of the shards' states, kept as 32-bit floats."""
    s = toxicity.Settings(bits=10, l1=0.1, shard_rows=shard_rows)
    rows = [(i, f"{text} word{i % 60} also{i % 14}", label) for i, text, label in ROWS]  # words that tell the label
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    dealt = -(-len(rows) // shard_rows)
    model = toxicity.train(df, df, s)
    # the shards that Spark deals, by the hashes it deals them by
    order = df.select("text", "label", F.pmod(F.hash(F.xxhash64(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))), F.lit(dealt)).alias("p"), F.xxhash64("doc_id", F.lit(1)).alias("o")).orderBy("p", "o").collect()
    shards = []
    for p in range(dealt):
        own = [(plain_features(r.text, s.bits), r.label) for r in order if r.p == p]
        shards += [own[i : i + shard_rows] for i in range(0, len(own), shard_rows)]
    z = n = [0.0] * (1 << s.bits)
    for _ in range(s.epochs):
        states = []
        for rows in shards:
            states.append((list(z), list(n)))
            plain_pass(rows, *states[-1], s)
        z, n = ([float(np.float32(np.mean([np.float32(x[k][i]) for x in states]))) for i in range(1 << s.bits)] for k in (0, 1))
    want = {i: -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2) for i in range(1 << s.bits) if abs(z[i]) > s.l1}
    got_weights = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
    near = {i for i in range(1 << s.bits) if abs(abs(z[i]) - s.l1) < 1e-3}
    assert want.keys() - near == got_weights.keys() - near and len(want) > 20
    assert all(got_weights[i] == pytest.approx(want[i], rel=1e-3, abs=1e-4) for i in want.keys() - near)


def test_repeated_and_odd_labels_count_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, label int")
    more = [(i, t, 5 if label else 0) for i, t, label in ROWS] + [(i, t, 0) for i, t, label in ROWS if label] + [(None, "x", 1), (3, "x", None)]
    a = toxicity.train(docs, docs, toxicity.Settings(l1=1.0))
    b = toxicity.train(docs, spark.createDataFrame(more, "doc_id long, text string, label int"), toxicity.Settings(l1=1.0))
    assert np.array_equal(a.at, b.at) and np.allclose(a.weights, b.weights)


def test_a_null_doc_id_is_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (5,)], "doc_id long").select("doc_id", queries.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {None: False, **{i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 5)}}
