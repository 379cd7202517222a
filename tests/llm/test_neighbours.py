"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from vigilspark.llm import neighbours as nn
from vigilspark.llm.plans import QUERIES

from conftest import SF


def brute_force(rows, every=20, k=20):
    """query id -> (id, score) of the k best, from (id, vector) rows of one width."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = [len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items()]
    return sum(hits) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    vectors, want = dict(rows), brute_force(rows)
    got = found(QUERIES["op10_nearest_neighbours"](spark, sf))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    for q, best in got.items():
        assert len(best) == len(want[q]) and best == sorted(best, key=lambda x: (-x[1], x[0]))
        for i, score in best:
            assert score == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), abs=1e-12)


def test_many_small_cells_and_unequal_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3_000, 12)) * rng.gamma(2, 1, (3_000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_force(rows, 20, 5)
    got = found(nn.nearest(df, 20, 5, stop=0.97, fit_rows=500, cell_rows=100))
    assert recall(got, want) >= 0.9
    everything = found(nn.nearest(df, 20, 5, stop=1.1, fit_rows=500, cell_rows=100))
    assert {q: [i for i, _ in b] for q, b in everything.items()} == {q: [i for i, _ in b] for q, b in want.items()}


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(i, [0.0, 1.0]) for i in range(100, 103)] + [(200, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, key string")
    assert found(nn.nearest(df.union(df), 20, 4)) == brute_force(rows, 20, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (None, [1.0, 1.0]), (7, [3.0, 1.0]), (20, [1.0, 0.5]), (40, [1.0, 1.0, 1.0]), (60, [2.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(nn.nearest(df)) == {0: [(7, 5.0), (20, 2.0)], 20: [(7, 3.5), (0, 2.0)], 40: [(60, 3.0)], 60: [(40, 3.0)]}
    assert nn.nearest(df.limit(0)).count() == 0
    assert nn.nearest(df.filter("vec_id = 0")).count() == 0


def test_chi_square_law():
    draws = np.random.default_rng(2).chisquare(nn.DIMENSIONS, 200_000)
    for x in (1.0, 7.0, 20.0):
        assert abs(float(nn.chi_square(np.array(x))) - (draws <= x).mean()) < 0.005


def test_long_and_short_finite_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 6))
    x[3] *= 1e155
    x[40] *= 1e-155
    x[41] *= 1e-155
    x[60] *= 1e300
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute_force(rows), found(nn.nearest(df))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    for q, best in got.items():
        assert len(best) == 20 and all(score == float((x[q] * x[i]).sum()) for i, score in best)


def visited_share(x, queries):
    """Leaves that queries visit in the band that holds most points, of all its leaves."""
    log = nn.log_lengths(x)
    octave = np.floor(log.max() - log).astype(int)
    bands = nn.length_bands(list(zip(*map(np.ndarray.tolist, np.unique(octave, return_counts=True)))))
    first, last = max(bands, key=lambda b: ((octave >= b[0]) & (octave <= b[1])).sum())
    band = x[(octave >= first) & (octave <= last)]
    longest, direction = nn.log_lengths(band).max(), nn.projection(x.shape[1] + 1)
    leaves = nn.Leaves(nn.lifted(nn.shrunk(band, longest)) @ direction)
    lengths = nn.log_lengths(queries)
    projected = np.column_stack([nn.shrunk(queries, lengths), np.zeros(len(queries))]) @ direction
    _, _, visited = nn.search(queries, projected, leaves, band, lengths + longest, 21, nn.STOP, np.full(len(queries), -np.inf))
    return visited.mean() / len(leaves.rows)


def test_one_long_vector_does_not_loosen_the_test():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 8_192)] + 0.3 * rng.standard_normal((8_192, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain = visited_share(x, x[:200])
    longer = visited_share(np.vstack([x, 1000 * x[5]]), x[:200])
    print(f"leaves visited: {plain:.3f}, with one vector 1,000 times longer {longer:.3f}")
    assert plain < 0.6 and longer <= plain + 1e-9


def test_bands():
    assert nn.length_bands([(0, 100)]) == [(0, 0)]
    assert nn.length_bands([(0, 1), (9, 500), (10, 400), (11, 3), (30, 2)]) == [(0, 0), (9, 9), (10, 30)]
    x = np.array([[3.0, 4.0], [1e-160, 0.0], [6e200, 8e200]])
    assert np.allclose(nn.log_lengths(x), [np.log2(5), np.log2(1e-160), np.log2(1e201)])
    assert np.allclose(np.linalg.norm(nn.shrunk(x, nn.log_lengths(x)), axis=1), 1)


def test_uneven_lengths_over_bands(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2_000, 8)) * (2.0 ** rng.integers(-12, 3, (2_000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(nn.nearest(df, 20, 5, cell_rows=200)), brute_force(rows, 20, 5)) >= 0.95
