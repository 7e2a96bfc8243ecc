"""Operators 5, 9, 6 against brute force on small tables."""
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from featurescape.llm import components, jaccard, suffixes, vptree


def _link_brute(docs, size, percent):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)}
        sets.append(grams or ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(docs)), 2):
        common = len(sets[x] & sets[y])
        if common and 100 * common >= percent * len(sets[x] | sets[y]):
            parent[find(x)] = find(y)
    out = []
    for x, (key, _) in enumerate(docs):
        ids = [docs[y][0] for y in range(len(docs)) if find(y) == find(x) and docs[y][0] is not None]
        out.append((key, len(sets[x]), min(ids) if ids else None))
    return sorted(out, key=str)


def _near_copies(rng, n):
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(9)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice([*words, f"New{rng.randrange(99)}"])
        docs.append((i if i % 17 else None, " ".join(w) if i % 31 else None))
    return docs + [(900, ""), (901, " \n"), (902, "A b"), (903, "a B"), (904, "a"), (902, "A b")]


@pytest.mark.parametrize("options", [
    {}, {"frequent": 3, "pairs_up_to": 40, "counters": 1 << 12},
    {"size": 5, "percent": 80, "frequent": 5, "counters": 1 << 10}])
def test_components_of_similar_sets(spark, options):
    docs = _near_copies(random.Random(7), 160)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string")
    got = sorted(map(tuple, jaccard.link_components(df, **options).collect()), key=str)
    assert got == _link_brute(docs, options.get("size", 3), options.get("percent", 90))


def test_components_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_components(df).collect() == []


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert got[node] == min(seen)
    assert set(got) == set(near)


def _repeats_brute(docs, width):
    texts = [(key, (t or "").encode()) for key, t in docs]
    starts = Counter(b[k:k + width] for _, b in texts for k in range(len(b) - width + 1))
    out = []
    for key, b in texts:
        mark = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if starts[b[k:k + width]] > 1:
                mark[k:k + width] = b"\1" * width
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = len([r for r in bytes(mark).split(b"\0") if r])
        out.append((key, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("gram,hot", [(12, 100_000), (25, 100_000), (12, 1)])
def test_repeated_strings(spark, gram, hot):
    rng = random.Random(gram)
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    docs = []
    for i in range(30):
        t = "".join(rng.choice("abc xyz") for _ in range(rng.randint(0, 200)))
        if rng.random() < .6:
            a = rng.randint(0, 200)
            t += passage[a:a + rng.randint(20, 150)] + "".join(rng.choice("abc") for _ in range(30))
        if rng.random() < .2 and docs:
            t = docs[-1][1] or ""
        docs.append((i if i % 9 else None, t if i != 7 else None))
    docs += [(100, "a" * 500), (101, "ab" * 300), (102, "a" * 39), (103, "q" * 41), (103, "q" * 41)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, token int")
    got = sorted(map(tuple, suffixes.repeat_digests(df, width=40, gram=gram, hot=hot).collect()), key=str)
    assert got == _repeats_brute(docs, 40)
    kept = {r.doc_id: r for r in suffixes.remove_repeats(df, width=40, gram=gram, hot=hot).collect()}
    for key, n, removed, runs, digest in got:
        if key is not None and key != 103:
            assert hashlib.sha256(kept[key].kept).hexdigest() == digest and len(kept[key].ranges) == runs


def test_repeated_strings_of_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeat_digests(df).collect() == []


def test_multikey_order_sorts():
    rng = np.random.default_rng(2)
    group, symbols = rng.integers(0, 3, 400), rng.integers(0, 3, (400, 4)).astype(np.uint64)
    order = suffixes.multikey_order(group, symbols)
    rows = [(group[i], *symbols[i]) for i in order]
    assert rows == sorted(rows)


def _vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:90] = x[7]                                            # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(700, None), (800, [0.0] * 8), (900, [float("nan")] * 8), (1000, [1.0, None] + [0.0] * 6),
                   (1100, []), (1200, [1.0, 2.0]), (None, [1.0] * 8), (200, rows[200][1])]


def test_exact_search_and_recall(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
            and np.isfinite(v).all() and any(v)]
    for factor in (1.0, vptree.FACTOR):
        got = {}
        for r in vptree.nearest(df, factor=factor).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        hit = total = 0
        for q, x in {i: v for i, v in good if i % 100 == 0}.items():
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(x))[:10]
            mine = [(round(s, 12), i) for _, i, s in sorted(got.get(q, []))]
            if factor == 1.0:
                assert mine == [(round(s, 12), i) for s, i in near]
            hit += len({i for _, i in mine} & {i for _, i in near})
            total += len(near)
        assert hit >= 0.9 * total
    assert set(got) == {i for i, _ in good if i % 100 == 0 and i != 1200}


def test_search_without_rows(spark):
    assert vptree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
