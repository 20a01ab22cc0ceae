from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyweave.llm import queries, whitening
from tests.oracle import SMALL

NAN, INF = float("nan"), float("inf")


def brute(vectors):
    """Whole-number moments of usable vectors, and numpy's eigenvectors."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    d = [[n * r[i] - s[i] for i in range(dim)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dim)] for i in range(dim)])
    e, u = np.linalg.eigh(v)
    centred = np.array([[float(Fraction(k, n)) for k in r] for r in d])
    return n, [sum(k * k for k in r) for r in d], centred, e[::-1], u[:, ::-1], v


def check(rows, kept, components=8):
    n, dev, centred, e, u, v = brute([vec for _, vec in kept])
    k = min(components, len(e))
    assert len(rows) == k * len(kept)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    got = sorted(((r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in rows), key=repr)
    for c in range(k):
        own = [r for r in got if r[1] == c + 1]
        assert own[0][4] == pytest.approx(e[c] / np.trace(v), rel=1e-12)
        want = {i: (dev[m], centred[m] @ u[:, c] / np.sqrt(e[c])) for m, (i, _) in enumerate(kept)}
        sign = np.sign(sum(want[r[0]][1] * r[3] for r in own))
        for r in own:
            assert r[2] == want[r[0]][0] and sign * r[3] == pytest.approx(want[r[0]][1], abs=1e-9)


def test_query_against_whole_numbers(spark):
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    out = queries.op11_embedding_whitening(spark, SMALL)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(out.collect(), kept)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, key string, n string")


def test_odd_vectors_are_left_out(spark):
    rng = np.random.default_rng(1)
    kept = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [NAN, 0.0, 0.0]), (103, [INF, 0.0, 0.0]), (104, [-INF, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [])]
    check(whitening.whitened_rows(frame(spark, kept + odd)).collect(), kept)


def test_equal_vectors_empty_tables_and_null_ids(spark):
    assert whitening.whitened_rows(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whitened_rows(frame(spark, [])).count() == 0
    assert whitening.whitened_rows(frame(spark, [(1, []), (2, None)])).count() == 0
    rows = whitening.whitened_rows(frame(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [3.0, 6.0])])).collect()
    assert sorted(repr(r.vec_id) for r in rows) == ["1", "None", "None"]  # one direction only
    assert {r.component for r in rows} == {1} and rows[0].identity_error < 1e-9


def test_far_means_do_not_cancel(spark):
    """Whole numbers about 1e12 with deviations of a few."""
    rows = [(i, [1e9 + i % 3 / 1024, 1e9 + i % 5 / 1024]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(whitening.whitened_rows(df).collect(), rows)


def test_a_deviation_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e7]), (2, [-1e7])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="CAST_OVERFLOW|NUMERIC_VALUE_OUT_OF_RANGE"):
        whitening.whitened_rows(df).collect()
    model = whitening.fit(df, "embedding", 8)
    assert {int(r.deviation) for r in whitening.whiten(df, model, "vec_id", "embedding").collect()} == {(2 * 1024 * 10**7) ** 2}


@settings(deadline=None, max_examples=80)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20), st.floats(-1e6, 1e6))
def test_double_doubles_are_exact_enough(values, factor):
    a = np.array(values)
    p = whitening.dd_products((a, np.zeros(len(a))), (np.full(len(a), factor), np.zeros(len(a))))
    exact = sum(Fraction(v) * Fraction(factor) for v in values)
    hi, lo = whitening.dd_total(p)
    assert abs(Fraction(float(hi)) + Fraction(float(lo)) - exact) <= Fraction(1, 10**29) * sum(abs(Fraction(v) * Fraction(factor)) for v in values) + Fraction(1, 10**280)


def test_many_tasks_merge_to_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    a, b = (whitening.fit(frame(spark, rows).repartition(n), "embedding", 4) for n in (1, 150))
    assert np.array_equal(a.moments.covariance, b.moments.covariance) and a.moments.sums == b.moments.sums
