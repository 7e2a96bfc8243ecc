import logging
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from event_log import most_uneven, tasks_of
from featurescape.operators import cluster, spatial
from featurescape.session import materialize


def greedy(points, r):
    """(clustered, representative) from the definition: an item is a seed if no seed
    before it is near; all items near a seed, if there are two, are its cluster, which
    is shown by the item closest to its mean; the last seed's cluster counts."""
    x = np.array(points, float).reshape(-1, 2)
    near = np.hypot(*(x[:, None] - x[None, :]).transpose(2, 0, 1)) <= r
    seeds = []
    for i in range(len(x)):
        if not near[i, seeds].any():
            seeds.append(i)
    shown = np.full(len(x), -1)
    for members in (np.flatnonzero(near[s]) for s in seeds):
        if len(members) > 1:
            away = np.hypot(*(x[members] - x[members].mean(axis=0)).T)
            shown[members] = members[np.argmin(away)]
    return (shown >= 0).tolist(), (shown == np.arange(len(x))).tolist()


def _frame(spark, pts):
    return spark.createDataFrame([(str(i), i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                                 "ID string, _ord long, x double, y double").repartition(3)


@pytest.mark.parametrize("seed,r", [(1, 10.0), (2, 15.0), (3, 7.5), (4, 25.0)])
def test_ball_clusters_match_greedy(spark, seed, r):
    rng = np.random.default_rng(seed)
    pts = [(float(x), float(y)) for x, y in rng.uniform(0, 120, size=(120, 2))]
    got = {row["ID"]: row for row in cluster.ball_clusters(_frame(spark, pts), r).collect()}
    clustered, rep = greedy(pts, r)
    for i in range(len(pts)):
        assert got[str(i)]["clustered"] == clustered[i], i
        assert got[str(i)]["representative"] == rep[i], i
        assert got[str(i)]["visible"] == (not clustered[i] or rep[i])


def test_chain_in_order_and_shuffled(spark):
    r = 10.0
    pts = [(i * 0.9 * r, 0.0) for i in range(14)]
    for order in (list(range(14)), [5, 0, 13, 2, 9, 1, 7, 12, 3, 11, 4, 8, 6, 10]):
        seq = [pts[k] for k in order]
        got = {row["ID"]: row for row in cluster.ball_clusters(_frame(spark, seq), r).collect()}
        clustered, rep = greedy(seq, r)
        assert [got[str(i)]["clustered"] for i in range(14)] == clustered
        assert [got[str(i)]["representative"] for i in range(14)] == rep


def test_coincident_points_form_one_cluster(spark):
    pts = [(1.0, 1.0)] * 3 + [(500.0, 500.0)]
    got = {row["ID"]: row for row in cluster.ball_clusters(_frame(spark, pts), 10.0).collect()}
    assert [got[str(i)]["clustered"] for i in range(4)] == [True, True, True, False]
    assert sum(got[str(i)]["representative"] for i in range(3)) == 1
    assert got["3"]["visible"]


def test_radius_neighbors_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-50, 50, size=(200, 2))] + [(0.0, 0.0)] * 4
    r = 6.0
    got = {(a, b) for a, b, _ in spatial.radius_neighbors(_frame(spark, pts), r).collect()}
    want = {(str(i), str(j)) for i, p in enumerate(pts) for j, q in enumerate(pts)
            if math.hypot(p[0] - q[0], p[1] - q[1]) <= r}
    assert got == want


def test_radius_neighbors_broadcasts_no_items(spark):
    df = materialize(_frame(spark, [(float(i), 0.0) for i in range(50)]))
    found = spatial.radius_neighbors(df, 1.0)
    assert len(found.collect()) == 50 + 2 * 49
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_nearest_ties_first_and_strict_tolerance(spark):
    pts = [(0.0, 5.0), (0.0, -5.0), (5.0, 0.0)]
    df = _frame(spark, pts)
    best = spatial.nearest(df, 0.0, 0.0, 6.0).collect()
    assert best[0]["ID"] == "0"           # three at distance 5: first wins
    assert spatial.nearest(df, 0.0, 0.0, 5.0).count() == 0   # strict <
    probes = spark.createDataFrame([("p", 0.0, 0.0), ("q", 100.0, 100.0)], "pid string, x double, y double")
    got = {r["pid"]: r["ID"] for r in spatial.nearest_join(probes, df, 6.0).collect()}
    assert got == {"p": "0", "q": None}


def test_grid_clusters_representative(spark):
    pts = [(0.1, 0.1), (0.9, 0.9), (0.5, 0.5), (5.0, 5.0)]
    g = {(r["cell_x"], r["cell_y"]): r for r in cluster.grid_clusters(_frame(spark, pts), 2.0).collect()}
    assert g[(0, 0)]["n"] == 3 and g[(0, 0)]["representative"] == "2"
    assert g[(2, 2)]["n"] == 1


def test_view_predicates(spark):
    df = _frame(spark, [(0.0, 0.0), (10.0, 10.0), (25.0, 0.0)])
    ids = {r["ID"] for r in spatial.select_rect(df, (10.0, 10.0, -1.0, -1.0)).collect()}
    assert ids == {"0", "1"}
    vis = {r["ID"] for r in df.where(spatial.visible_in_view(df, 0.0, 20.0, -5.0, 20.0, 5.0)).collect()}
    assert vis == {"0", "1"}                # 25-5 = 20 is not < 20
    lens = {r["ID"] for r in spatial.within_radius(df, 0.0, 0.0, 20.0).collect()}
    assert lens == {"0", "1"}


def test_ball_clusters_with_a_third_of_points_in_one_cell(spark):
    rng = np.random.default_rng(11)
    spread = [(float(x), float(y)) for x, y in rng.uniform(0, 200, size=(120, 2))]
    blob = [(50.0 + float(dx), 50.0 + float(dy)) for dx, dy in rng.uniform(-0.5, 0.5, size=(60, 2))]
    pts = spread[:40] + blob + spread[40:]
    got = {row["ID"]: row for row in cluster.ball_clusters(_frame(spark, pts), 10.0).collect()}
    clustered, rep = greedy(pts, 10.0)
    assert [got[str(i)]["clustered"] for i in range(len(pts))] == clustered
    assert [got[str(i)]["representative"] for i in range(len(pts))] == rep


def test_ordered_chain_takes_a_round_per_tile_crossing(spark, caplog):
    n, r = 20000, 10.0
    pts = spatial.with_cells(spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"),
                                                   (F.col("id") * 0.9 * r).alias("x"), F.lit(3.0).alias("y")), r)
    with caplog.at_level(logging.INFO, logger="featurescape.operators.cluster"):
        seeds = {row["sord"] for row in cluster.cluster_seeds(pts, r, tile_items=4096).collect()}
    assert seeds == set(range(0, n, 2))
    assert int(re.search(r"(\d+) rounds", caplog.text)[1]) < 20


def test_tiles_split_crowded_nodes_only(spark):
    cells = spark.createDataFrame([(0, 0, 9), (1, 0, 9), (-1, 5, 1), (700, 700, 1), (701, 700, 1)], "cx long, cy long, n int")
    got = {(t.cx, t.cy): (t.level, t.tx, t.ty) for t in spatial.quadtree_leaves(cells, 10, cluster.TREE_LEVELS).collect()}
    assert got[0, 0] == (0, 0, 0) and got[1, 0] == (0, 1, 0)
    assert got[700, 700] == got[701, 700] and got[700, 700][0] == 9
    assert got[-1, 5][0] == cluster.TREE_LEVELS


# Joins by shuffle, one task per partition: what a cluster does with large tables.
PLAIN = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
         "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.shuffle.partitions": "16"}


def _crowd(n):
    """Two thirds of the points in one cell of the joins, at different positions."""
    rng = np.random.default_rng(12)
    crowd = rng.uniform(0.1, 0.9, size=(2 * n // 3, 2))
    return np.concatenate([crowd, rng.uniform(-300, 300, size=(n - len(crowd), 2))]).tolist()


def test_no_task_gets_a_crowded_cell(spark):
    pts = _crowd(3000)
    df = materialize(_frame(spark, pts))
    probes = materialize(df.where("_ord % 3 = 0").select(F.col("ID").alias("pid"), "x", "y"))
    run = {
        "grid": lambda: cluster.grid_clusters(df, 2.0, limit=100),
        "nearest": lambda: spatial.nearest_join(probes, df, 2.0, leaf_items=16),
        "radius": lambda: spatial.radius_neighbors(df.where("_ord % 4 = 0"), 2.0, limit=50),
        "balls": lambda: cluster.ball_clusters(df, 2.0, limit=100, tile_items=16),
    }
    for name, query in run.items():
        with tasks_of(spark, **PLAIN) as stages:
            query().write.format("noop").mode("overwrite").save()
        assert most_uneven(stages, 1000) < 5, (name, str([sorted(s) for s in stages if most_uneven([s], 1000) >= 5]))


def test_crowded_cells_give_the_same_results(spark):
    pts = _crowd(300) + [(0.5, 0.5)] * 9
    df = _frame(spark, pts)
    far = [(float(a), float(b)) for a, b in np.random.default_rng(5).uniform(-2, 3, size=(80, 2))]
    probes = spark.createDataFrame([(f"p{i}", *p) for i, p in enumerate(far)], "pid string, x double, y double")
    for tol in (0.05, 2.0):
        got = {r["pid"]: (r["ID"], r["dist"]) for r in spatial.nearest_join(probes, df, tol, leaf_items=4).collect()}
        for i, p in enumerate(far):
            d, first = min((math.hypot(p[0] - q[0], p[1] - q[1]), j) for j, q in enumerate(pts))
            item, dist = got[f"p{i}"]
            assert item == (str(first) if d < tol else None) and (d >= tol or abs(dist - d) < 1e-12)
    plain = sorted(map(tuple, cluster.grid_clusters(df, 2.0).collect()))
    split = sorted(map(tuple, cluster.grid_clusters(df, 2.0, limit=10).collect()))
    assert [(r[:3], r[5]) for r in plain] == [(r[:3], r[5]) for r in split]
    pairs = [sorted(map(tuple, spatial.radius_neighbors(df, 0.3, limit=n).collect())) for n in (7, 10_000)]
    assert pairs[0] == pairs[1]
    balls = [sorted(map(tuple, cluster.ball_clusters(df, 0.4, limit=n).collect())) for n in (10, 10_000)]
    assert balls[0] == balls[1]
    clustered, rep = greedy([tuple(p) for p in pts], 0.4)
    assert {b[0]: (b[3], b[4]) for b in balls[0]} == {str(i): (clustered[i], rep[i]) for i in range(len(pts))}
