"""Operator 12 against brute force over the tokenizers' own output."""
import bisect
import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from featurescape.llm import crosstok
from featurescape.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(A)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=B)
ALPHABET = byte_alphabet()


def _piece(i):
    return bytes([int(LIB_B.id_to_piece(i)[3:-1], 16)]) if LIB_B.is_byte(i) else \
        LIB_B.id_to_piece(i).replace("▁", " ").encode()


def _tokens(text):
    """(id, start, end) of both sides, None if they do not spell the text."""
    if not text:
        return None
    a = LIB_A.encode(" " + text, add_special_tokens=False).ids
    sides = [[(i, bytes(ALPHABET[c] for c in LIB_A.id_to_token(i))) for i in a],
             [(i, _piece(i)) for i in LIB_B.encode(text)]]
    if any(b"".join(raw for _, raw in s) != (" " + text).encode() for s in sides):
        return None
    out = []
    for side in sides:
        at, held = 0, []
        for i, raw in side:
            held.append((i, at, at + len(raw)))
            at += len(raw)
        out.append(held)
    return out


def _one(text):
    found = _tokens(text)
    if found is None:
        return [], [], [], []
    a, b = found
    b_starts = [t[1] for t in b]
    links = [(x, y) for x in range(len(a))
             for y in range(bisect.bisect_right(b_starts, a[x][1]) - 1, bisect.bisect_left(b_starts, a[x][2]))]
    cuts = sorted({t[2] for t in a} & {t[2] for t in b})
    groups = [([], []) for _ in cuts]
    for side, tokens in enumerate((a, b)):
        for t in tokens:
            groups[bisect.bisect_right(cuts, t[1])][side].append(t[0])
    return [t[0] for t in a], [t[0] for t in b], links, groups


def _brute(docs):
    rows = [_one(text) for _, text in docs]
    total = Counter((a[x], b[y]) for a, b, links, _ in rows for x, y in links)
    most = Counter()
    for (_, y), n in total.items():
        most[y] = max(most[y], n)
    out = []
    for (key, _), (a, b, links, groups) in zip(docs, rows):
        pairs = [(a[x], b[y]) for x, y in links]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(total[p] == most[p[1]] for p in pairs),
                    sum(total[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b\n", "\n x", "tab\t x \t", "<|endoftext|> and <s></s> <unk>",
         "Ünïcödé 日本語 🙂 <0x41>", "a b  c", "x▁y ▁ z", "\x00\x1c \x1f", "ﬁ ① Ａ", "don't we'll 12 345 6",
         "aaaa aaaaaaa aaaaaaaaaaaaaaaa", "é" * 400, "word " * 700, "é ​﻿   q", "A-b_c.d/e " * 50]


@pytest.fixture(scope="module")
def sides():
    with open(A, "rb") as a, open(B, "rb") as b:
        return crosstok.byte_level(a.read()), crosstok.sentence_pieces(b.read())


def test_words_spell_the_librarys_tokens(sides):
    rng = random.Random(5)
    letters = ["a", "b", "aa", "the", " ", " ", "\n", "é", "9", ".", "▁", " ", "'s", "🙂", "　"]
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(800)]
    found = crosstok.Aligned(pa.array(["cut off", *texts], pa.string()).slice(1), sides)
    for i, text in enumerate(texts):
        want = _one(text)
        for side in (0, 1):
            assert found.ids[side][found.row[side] == i].tolist() == want[side], text


def test_alignment(spark):
    docs = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, links string")
    got = [(r.doc_id, r.a_ids, r.b_ids, [tuple(x) for x in r.links], [tuple(g) for g in r.groups])
           for r in crosstok.align(df, A, B).collect()]
    assert sorted(map(str, got)) == sorted(str((key, *_one(text))) for key, text in docs)


@pytest.mark.parametrize("batch_bytes", [1, 100, 1 << 20])
def test_digests(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(crosstok, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(crosstok, "STEP_BYTES", 64)
    docs = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, "word word"), (3, "word word")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, batch int")
    got = crosstok.digests(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _brute(docs)))


def test_no_rows_and_no_texts(spark):
    assert crosstok.digests(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    df = spark.createDataFrame([("x", None), ("y", "")], "doc_id string, text string")
    assert sorted(map(tuple, crosstok.digests(df, A, B).collect())) == [("x", *[0] * 6, ""), ("y", *[0] * 6, "")]


def test_long_texts(sides):
    text = ("lorem ipsum dolor " * 20000) + "z" * 20000
    found = crosstok.Aligned(pa.array([text]), sides)
    assert found.ids[0].tolist() == LIB_A.encode(" " + text, add_special_tokens=False).ids
    assert found.ids[1].tolist() == LIB_B.encode(text)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = crosstok.digests(df, A, B)
    assert sorted(map(tuple, got.collect())) == sorted(_brute(docs))


def test_unfit_vocabularies(sides):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f, pytest.raises(ValueError):
        crosstok.byte_level(f.read())
