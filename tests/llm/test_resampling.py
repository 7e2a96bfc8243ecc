"""Operator 11 against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from featurescape.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _buckets(text):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _brute(docs, target, percent=5, least=20):
    held = Counter(b for _, text in docs for b in _buckets(text))
    wanted = Counter(b for text in target for b in _buckets(text))
    big, small = sum(held.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (big + 10000) / ((held[b] + 1) * (small + 10000))))
            for b in range(10000)]
    rows = []
    for key, text in docs:
        found = _buckets(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([key, len(found), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(_words(text))])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(order[:percent * len(order) // 100]):
        r[4] = i + 1
    return rows


def _same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


@pytest.mark.parametrize("texts", [
    [None, "", " ", "..", "A b", "ä Ö x", "É" * 3, "a" * 70000 + " B2", "x\ny\tz  x", "\x80\x85  w", "one"],
    ["a b c d " * 9, "", None], [None], []])
def test_features_of_a_batch(texts):
    array = pa.array([*texts, "cut off"], pa.string())
    for part in (array, array.slice(1)):
        n, runs = resampling.features(part)
        for size, (buckets, row) in enumerate(runs, 1):
            for i, text in enumerate(part.to_pylist()):
                w = _words(text)
                assert n[i] == len(w)
                assert buckets[row == i].tolist() == [
                    zlib.crc32(" ".join(w[k:k + size]).encode()) % 10000 for k in range(len(w) - size + 1)]


def test_pieces_over_the_splitters_blocks(monkeypatch):
    monkeypatch.setattr(resampling, "SPLIT_CHARS", 7)
    array = pa.array(["a-b c..d eeeeeeeeeee f", None, "- -- a"])
    n, runs = resampling.features(array)
    assert n.tolist() == [6, 0, 1]
    assert runs[0][0].tolist() == _buckets("a b c d eeeeeeeeeee f")[:6] + _buckets("a")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = resampling.resample(spark.read.parquet(f"{sf}/documents.parquet"),
                              spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    _same(got.collect(), _brute(docs, target))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    docs = [(i // 2, f"Word{i % 5} " * 30 + ("goal line " * (i % 7))) for i in range(80)]
    docs += [(None, "goal line " * 20), (None, None), (7, ""), (8, "x"), (3, "word3 " * 30), (3, "word3 " * 30)]
    target = ["Goal line", None, "goal LINE goal"]
    df = spark.createDataFrame([(*d, "id", 1, 2.0) for d in docs],
                               "doc_id long, text string, id string, rank int, place double")
    other = spark.createDataFrame([(t, 5) for t in target], "text string, bucket int")
    _same(resampling.resample(df, other, percent=30).collect(), _brute(docs, target, percent=30))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, other).collect() == []
    _same(resampling.resample(df, none.select("text")).collect(), _brute(docs, []))
