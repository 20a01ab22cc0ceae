import math

import numpy as np
import pytest

from skyweave.operators import paths

SCHEMA = "uav_id long, t_idx long, gx double, gy double, px double, py double"


def rows_of(key, a, b):
    at = lambda x, t: [float(v) for v in x[t]] if t < len(x) else [None, None]
    return [(key, t, *at(a, t), *at(b, t)) for t in range(max(len(a), len(b)))]


@pytest.mark.parametrize("band", [None, 64, 16, 15, 3])
def test_tiles_give_what_the_whole_matrix_gives(spark, band):
    """Lengths at, around and away from the tiles' width, more or fewer points on one side."""
    rng = np.random.default_rng(3)
    made = {k: (rng.normal(size=(n, 2)).cumsum(0), rng.normal(size=(m, 2)).cumsum(0)) for k, (n, m) in enumerate([(70, 70), (16, 17), (33, 32), (1, 1), (1, 40), (65, 50)])}
    made[None] = made[0][0][:20], made[0][1][:30]
    track = spark.createDataFrame([r for k, (a, b) in made.items() for r in rows_of(k, a, b)], SCHEMA)
    got = {r.uav_id: r for r in paths.path_distances(track.repartition(5), band, 16).collect()}
    assert len(got) == len(made)
    for k, (a, b) in made.items():
        assert got[k].dtw == pytest.approx(paths.dtw(a, b, band)) and got[k].frechet == pytest.approx(paths.frechet(a, b, band)), k


def test_bands_that_end_at_a_tile(spark):
    """One side stands still, so that the best way runs along the band's edge, through corners of tiles."""
    a = np.stack([np.arange(48.0), np.zeros(48)], 1)
    b = np.stack([np.maximum(np.arange(48.0) - 16, 0), np.zeros(48)], 1)
    for x, y in ((a, b), (b, a)):
        row = paths.path_distances(spark.createDataFrame(rows_of(1, x, y), SCHEMA), 16, 16).first()
        assert row.dtw == pytest.approx(paths.dtw(x, y, 16)) and row.frechet == pytest.approx(paths.frechet(x, y, 16))


def test_no_way_no_points_no_rows(spark):
    a, b = np.zeros((40, 2)), np.ones((3, 2))
    track = spark.createDataFrame(rows_of(1, a, b) + rows_of(2, a, b[:0]) + [(3, 0, None, 1.0, 1.0, None), (4, 0, math.nan, 1.0, 3.0, 4.0), (4, 1, 0.0, 0.0, math.inf, 1.0), (4, None, 0.0, 0.0, 3.0, 4.0)], SCHEMA)
    got = {r.uav_id: (r.dtw, r.frechet) for r in paths.path_distances(track, 5, 8).collect()}
    assert got == {1: (math.inf, math.inf), 2: (None, None), 3: (None, None), 4: (5.0, 5.0)}
    assert {r.uav_id: (r.dtw, r.frechet) for r in paths.path_distances(track, 5, 1000).collect()} == got
    assert paths.path_distances(track.limit(0)).count() == 0
