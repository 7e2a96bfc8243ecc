import numpy as np
import pytest
from event_log import tasks_of

from featurescape.operators import embed, knn
from featurescape.session import materialize


def _brute(x, ids, k):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((d[j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out[ids[i]] = [o[1] for o in order]
    return out


@pytest.mark.parametrize("seed,k,options", [(1, 3, {}), (2, 7, {"cells": 12, "chunk_rows": 8}),
                                            (3, 2, {"cells": 30, "chunk_rows": 3}), (4, 160, {"cells": 4})])
def test_knn_exact_against_brute_force(spark, seed, k, options):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, 8)) * 10
    x = np.stack([centers[i % 4] + rng.normal(size=8) for i in range(150)])
    x = np.concatenate([x, np.repeat(x[:1], 5, axis=0)])        # duplicates of one vector
    ids = [f"i{j:03d}" for j in range(len(x))]
    df = spark.createDataFrame([(ids[j], x[j].tolist()) for j in range(len(x))], "ID string, v array<double>")
    got = {}
    for r in embed.knn_graph(df, k=k, vec_col="v", **options).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    want = _brute(x, ids, k)
    assert {s: [d for _, d in sorted(v)] for s, v in got.items()} == want


@pytest.mark.parametrize("method", ["umap", "tsne"])
def test_embedding_keeps_label_neighbourhoods(spark, method):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(5, 16)) * 6
    labels = [i % 5 for i in range(200)]
    x = np.stack([centers[c] + rng.normal(size=16) for c in labels])
    df = spark.createDataFrame([(str(i), x[i].tolist()) for i in range(len(x))], "ID string, v array<double>")
    pos = embed.neighbor_embedding(df, method=method, vec_col="v", k=10, perplexity=10, rounds=10)
    p = {r["ID"]: (r["x"], r["y"]) for r in pos.collect()}
    pts = np.array([p[str(i)] for i in range(len(x))])
    agree = 0
    for i in range(len(pts)):
        d = ((pts - pts[i]) ** 2).sum(1)
        d[i] = np.inf
        nn = np.argsort(d)[:5]
        agree += sum(labels[j] == labels[i] for j in nn)
    assert agree / (5 * len(pts)) > 0.5        # chance level is 0.2
    assert np.isfinite(pts).all()


def test_knn_with_a_third_identical_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    x[::3] = x[0]                                  # 40 identical vectors
    ids = [f"v{j:03d}" for j in range(len(x))]
    df = spark.createDataFrame([(ids[j], x[j].tolist()) for j in range(len(x))], "ID string, v array<double>")
    got = {}
    for r in embed.knn_graph(df, k=4, vec_col="v", cells=6, chunk_rows=16).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    want = _brute(x, ids, 4)
    assert {s: [d for _, d in sorted(v)] for s, v in got.items()} == want


def test_tsne_bandwidth_meets_perplexity(spark):
    rng = np.random.default_rng(2)
    d = np.sort(rng.uniform(0.5, 3.0, size=30))
    knn = spark.createDataFrame([("q", f"n{j}", 1, float(d[j])) for j in range(30)],
                                "src string, dst string, rank int, dist double")
    w = embed.tsne_weights(knn, perplexity=8.0, n=1)
    # recover the conditional p_j|q (no reverse edges exist, so w = p / 2)
    p = np.array(sorted(r["w"] * 2 for r in w.where("src = 'q'").collect()))
    h = -(p * np.log(p)).sum()
    assert abs(h - np.log(8.0)) < 1e-6


def test_tsne_bandwidths_are_found_a_batch_at_once(spark):
    rng = np.random.default_rng(4)
    d = {f"s{i}": rng.uniform(0.0, 2.0, size=3 + i) for i in range(5)} | {"zero": np.zeros(6), "far": np.full(4, 1e9)}
    knn = spark.createDataFrame([(s, f"{s}-{j}", j + 1, float(x)) for s, v in d.items() for j, x in enumerate(v)],
                                "src string, dst string, rank int, dist double")
    w = embed.tsne_weights(knn, perplexity=2.5, n=1)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(sequence" not in plan.lower() and "lambda" not in plan.lower()
    got = {(r["src"], r["dst"]): r["w"] for r in w.collect()}
    for s, v in d.items():
        lo, hi = 1e-6, 1e6
        for _ in range(32):
            sigma = np.sqrt(lo * hi)
            p = np.exp(-v ** 2 / (2 * sigma ** 2))
            z = max(p.sum(), 1e-300)
            if np.log(z) + (v ** 2 * p).sum() / (2 * sigma ** 2 * z) > np.log(2.5):
                hi = sigma
            else:
                lo = sigma
        p = np.exp(-v ** 2 / (2 * lo * hi))
        for j, x in enumerate(p / max(p.sum(), 1e-300)):
            assert abs(got[s, f"{s}-{j}"] - x / 2) < 1e-12 and got[f"{s}-{j}", s] == got[s, f"{s}-{j}"]


def test_knn_skips_chunks_of_far_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([c * 50 + rng.normal(size=(60, 5)) for c in rng.normal(size=(20, 5))])
    df = spark.createDataFrame([(f"v{j:04d}", x[j].tolist()) for j in range(len(x))], "id string, v array<double>")
    graph, share = knn.knn_tables(df, 4, cells=40, chunk_rows=32)
    got = {}
    for r in graph.collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    want = _brute(x, [f"v{j:04d}" for j in range(len(x))], 4)
    assert {s: [d for _, d in sorted(v)] for s, v in got.items()} == want
    assert share < 0.25


def test_knn_sends_a_vector_once_for_each_block(spark):
    x = np.random.default_rng(3).normal(size=(1280, 64))
    df = materialize(spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, v array<double>"))
    with tasks_of(spark) as stages:
        graph, share = knn.knn_tables(df, 4, cells=2, chunk_rows=8)
        assert graph.count() == 4 * 1280
    assert share > 0.5
    assert stages.written < 100 * x.nbytes, stages.written / x.nbytes


def test_knn_of_few_items(spark):
    schema = "id string, v array<double>"
    assert knn.knn_tables(spark.createDataFrame([], schema), 3)[0].collect() == []
    assert knn.knn_tables(spark.createDataFrame([("a", [1.0])], schema), 3)[0].collect() == []
    two = knn.knn_tables(spark.createDataFrame([("a", [1.0]), ("b", [1.0])], schema), 3)[0].collect()
    assert sorted(map(tuple, two)) == [("a", "b", 1, 0.0), ("b", "a", 1, 0.0)]


def test_knn_keeps_the_best_of_all_blocks_in_one_place(spark):
    x = np.random.default_rng(5).normal(size=(960, 4))
    df = materialize(spark.createDataFrame([(f"{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>"))
    k = 100
    with tasks_of(spark) as stages:
        graph, _ = knn.knn_tables(df, k, cells=1, chunk_rows=8)
        rows = graph.collect()
    assert len(rows) == 960 * k
    read = max(sum(r) for r in stages)
    assert read < 960 * k, read                    # no neighbour found is dealt out once more
    got = {}
    for r in rows:
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    want = _brute(x, [f"{i:04d}" for i in range(960)], k)
    assert {s: [d for _, d in sorted(v)] for s, v in got.items()} == want


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-3, 1e6), (1e17, 0.0)])
def test_knn_is_exact_where_single_precision_is_not(spark, scale, shift):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 5)) * scale + shift
    x[100:] = x[:100] + rng.normal(size=(100, 5)) * scale * 1e-6          # near pairs
    x[10] += 1e5 * scale
    x[150:160] = x[50:60]                                                # ties
    ids = [f"i{j:03d}" for j in range(len(x))]
    df = spark.createDataFrame([(ids[j], x[j].tolist()) for j in range(len(x))], "id string, v array<double>")
    got = {}
    for r in knn.knn_tables(df, 6, cells=3, chunk_rows=16)[0].collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    assert {s: [d for _, d in sorted(v)] for s, v in got.items()} == _brute(x, ids, 6)


def test_numbers_and_names_give_one_graph(spark):
    x = np.random.default_rng(8).normal(size=(90, 3))
    rows = [(i, f"n{i:03d}", v.tolist()) for i, v in enumerate(x)]
    both = spark.createDataFrame(rows, "no long, name string, v array<double>")
    one, two = (sorted(map(tuple, knn.knn_tables(both.select(both[c].alias("id"), "v"), 5)[0].collect()))
                for c in ("no", "name"))
    assert [(f"n{a:03d}", f"n{b:03d}", r, d) for a, b, r, d in one] == two
