"""Operator 13 against brute force."""
import math

import numpy as np
import pytest

from featurescape.llm import rotated

LEAST = 0.93


def _cos(x, y):
    x, y = (np.array(v, float) / np.abs(np.array(v, float)).max() for v in (x, y))
    return float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))


def _fit(label, x):
    return label is not None and x is not None and len(x) > 0 and all(
        v is not None and math.isfinite(v) for v in x) and any(x)


def _brute(rows, least=LEAST):
    n = len(rows)
    links = [[j for j in range(n) if j != i and rows[i][2] == rows[j][2] and _fit(*rows[i][:0:-1])
              and _fit(*rows[j][:0:-1]) and len(rows[i][1]) == len(rows[j][1])
              and _cos(rows[i][1], rows[j][1]) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        name = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), name, rows[i][0] is not None and rows[i][0] == name))
    return out


def _same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def _groups(rng, n, dim):
    """Vectors around common ones, at angles on both sides of the threshold's."""
    middle = rng.normal(size=(6, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    out = []
    for i in range(n):
        noise = rng.normal(size=dim)
        noise *= rng.choice([0, 0.05, 0.15, 0.3, 0.6, 2]) / np.linalg.norm(noise)
        out.append((i, ((middle[i % 6] + noise) * rng.uniform(0.1, 9)).tolist(), int(rng.integers(3)) if i % 4 else 0))
    return out


@pytest.mark.parametrize("chunk", [1024, 30])
def test_links_and_components(spark, chunk):
    rows = _groups(np.random.default_rng(chunk), 240, 16)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, "
                                                            "rid string, ball int")
    _same(rotated.near_copies(df, chunk=chunk).collect(), _brute(rows))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (3, [1.0, 0.0], None),
            (4, [0.0, 0.0], 1), (5, None, 1), (6, [], 1), (7, [1.0, None], 1), (8, [inf, 1.0], 1), (9, [nan, 1.0], 1),
            (10, [1.0], 1), (11, [5.0], 1), (12, [1e300, 0.0], 1), (13, [1e-300, 0.0], 1), (14, [-1.0, 0.0], 1),
            (None, [0.0, 3.0], 7), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _same(rotated.near_copies(df).collect(), _brute(rows))
    assert rotated.near_copies(df.limit(0)).collect() == []
    _same(rotated.near_copies(df.where("label is null")).collect(), _brute([r for r in rows if r[2] is None]))


def test_large_group_of_copies_stays_few_balls(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=64)
    rows = [(i, (one + rng.normal(size=64) * 0.03).tolist(), 1) for i in range(900)]
    rows += [(900 + i, rng.normal(size=64).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    _same(rotated.near_copies(df, chunk=256).collect(), _brute(rows))
    x = np.array([r[1] for r in rows[:900]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(set(rotated.cover(x, math.acos(LEAST) / 2)[0].tolist())) < 10


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(8)
    u = rng.normal(size=(600, 48))
    u[300:] = u[:300] + rng.normal(size=(300, 48)) * rng.uniform(0.1, 2, size=(300, 1))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = rotated.Estimates(*rotated.encode(u), *rotated.to_bytes(u))
    every, true = slice(0, 600), u @ u.T
    off = ~np.eye(600, dtype=bool)
    assert abs((found.value(every, every) - true)[off].mean()) < 0.003
    i, j = np.nonzero(off)
    assert (found.upper(i, j) >= true[i, j]).all()
    for least in (0.2, 0.93):
        kept = set(zip(*(a.tolist() for a in found.above(every, every, least))))
        assert kept >= set(zip(*(a.tolist() for a in np.nonzero(true >= least))))
    slope = np.polyfit(true[off], found.value(every, every)[off], 1)[0]
    assert abs(slope - 1) < 0.02


def test_buckets_miss_no_more_than_stated():
    rng = np.random.default_rng(9)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.normal(size=u.shape)
    v -= (v * u).sum(axis=1, keepdims=True) * u
    v = LEAST * u + math.sqrt(1 - LEAST ** 2) * v / np.linalg.norm(v, axis=1, keepdims=True)   # at the threshold
    for bits in (0, 1, 5, 9):
        tables = rotated.tables_for(bits, LEAST)
        assert (rotated.bucket_keys(u, bits, tables) == rotated.bucket_keys(v, bits, tables)).any(axis=1).all()


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    _same(rotated.near_copies(df, chunk=50).collect(), _brute(rows))
