"""Operators 1, 2, 3, 4, 7, 8, 10 and the pipeline against brute force."""
import gc
import hashlib
import pickle
import random
import re
import time
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

import corpus_pipeline
from featurescape.llm import bpe, langid, licences, mixing, pagetext, phrases, pii, registry

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- language
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = registry.op1_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    train = [(i, "the and of this that" if i % 2 else "der und die das nicht", "en" if i % 2 else "de", "s")
             for i in range(60)]
    odd = [(100, None, "en", None), (101, "", None, None), (102, "12 ?!", "en", None), (None, "the that", None, None),
           (103, "的", "en", None), (104, "the of " * 300_000, None, None), (104, "und", None, None)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, label string")
    model = langid.fit(df)
    got = defaultdict(list)
    for r in langid.predict(df, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[100] == got[101] == got[102] == [("und", 0.0)]
    assert got[103][0][0] in ("de", "en") and got[None][0][0] == "en" and len(got[104]) == 2
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (100, 101, 102)").count() == 0
    assert langid.fit(df.where("false")) is None
    assert langid.predict(df, None).where("lang_pred != 'und'").count() == 0


# ---------------------------------------------------------------- pages
def _site(body, menu="<nav><a href='/x'>Menu</a></nav>"):
    return f"<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body>{menu}{body}</body></html>"


def test_page_text(spark):
    shared = "<div>All rights of this site</div>"
    pages = [
        (1, "http://a.org/1", _site("<article><h1>One &amp; two</h1><p>First<br>part <b>here</b><p>Second</article>"
                                    "<div class='comments'>me too</div>")),
        (2, "http://b.org/1", _site("<p>Alpha beta gamma of one page alone</p>" + shared)),
        (3, "http://b.org/2", _site("<p>Delta epsilon zeta of one page alone</p>" + shared)),
        (4, "http://b.org/3", _site("<p>Eta theta iota of one page alone</p>" + shared)),
        (5, "http://c.org/1", _site("<p>The same page</p>")), (6, "http://c.org/2", _site("<p>The same page</p>")),
        (7, None, None), (8, "x", ""), (9, "http://d.org/", "<p>cut &am"), (2, "http://b.org/1", "<p>x</p>")]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")
    got = defaultdict(list)
    for r in pagetext.main_texts(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["One & two\nFirst part here\nSecond"]
    assert got[3] == ["Delta epsilon zeta of one page alone"] and got[4] == ["Eta theta iota of one page alone"]
    assert got[5] == got[6] == ["The same page"] and got[7] == got[8] == [""] and got[9] == ["cut &am"]
    assert len(got[2]) == 2
    assert pagetext.main_texts(df.where("false")).collect() == []


def test_common_lines_is_longest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in "xy")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(pagetext.common_lines(a, b))
        assert len(found) == best[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in found)


def test_article_of_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.op2_page_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        words = [" ".join(pagetext.html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text == "\n".join(w for w in words if w)


def test_differencing_decides_marked_text(spark):
    def page(n):
        return (f"<article><p>Text of page {n} alone</p><p>Subscribe to our letter, it is free and comes every week of "
                f"the whole year</p></article>")
    pages = [(n, f"http://a.org/{n}", page(n)) for n in range(4)]
    # a run of copies that covers many buckets, and pages without text, lie between the pages that differ
    pages += [(n, f"http://b.org/{n:04}", f"<title>{n}</title>" + ("" if n % 7 == 5 else page("same")) if 0 < n < 300 else page(n))
              for n in range(301)]
    pages += [(900, "http://c.org/1", page(1)), (901, "http://c.org/2", page(1))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.url: r.text for r in pagetext.main_texts(df).collect()}
    assert len(got) == len(pages)
    assert all(got[f"http://a.org/{n}"] == f"Text of page {n} alone" for n in range(4))
    for n in range(301):
        want = f"Text of page {n} alone" if n in (0, 300) else "" if n % 7 == 5 else "Text of page same alone"
        assert got[f"http://b.org/{n:04}"] == want
    assert got["http://c.org/1"] == got["http://c.org/2"] and "Subscribe" in got["http://c.org/1"]


def test_headings_and_near_copies_stay(spark):
    def page(*lines, h1="Same title"):
        return f"<article><h1>{h1}</h1>" + "".join(f"<p>{t}</p>" for t in lines) + "</article>"
    pages = [(1, "http://a.org/1", page("one", "Subscribe")), (2, "http://a.org/2", page("Same title", "two", "Subscribe")),
             (3, "http://a.org/3", page("three", "Subscribe")),
             # b/2 and b/3 differ in one line of four
             (4, "http://b.org/1", page("zero", "Subscribe", h1="A")), (5, "http://b.org/2", page("p", "q", "r", "Subscribe", h1="B")),
             (6, "http://b.org/3", page("p", "Q", "r", "Subscribe", h1="B")), (7, "http://b.org/4", page("end", "Subscribe", h1="C"))]
    got = {r.page_id: r.text for r in pagetext.main_texts(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "Same title\none", 2: "Same title\nSame title\ntwo", 3: "Same title\nthree", 4: "A\nzero",
                   5: "B\np\nq\nr", 6: "B\np\nQ\nr", 7: "C\nend"}


def test_article_of_every_page_of_many(spark):
    """On 2,500 pages no heading goes, nothing is added, and lines of an article go only where
    both neighbours happen to hold them too (16 pages)."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    wrong = []
    for r in registry.op2_page_text(spark, "/root/testdata/sf0.1").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        words = [" ".join(pagetext.html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        words = [w for w in words if w]
        lines = iter(words)
        assert r.text.split("\n")[:1] == words[:1] and all(line in lines for line in r.text.split("\n"))
        if r.text != "\n".join(words):
            wrong.append(r.page_id)
    assert len(wrong) <= 16


def test_quotes_outside_values_are_no_quotes():
    def text(page):
        return pagetext.candidates(pagetext.lines_of(page))

    assert text("Hello <a href=\"x\"\">link</a> world") == ["Hello link world"]
    assert text("Hello <a title='it's'>link</a> world") == ["Hello link world"]
    assert text("Hello <a title=\"it's > that\">link</a> world") == ["Hello link world"]
    assert text("a <i data-x= '>' '>b</i>") == ["a b"]
    assert text("<p>a</p><p title=\"open>b</p><p>c</p>") == ["a", "b", "c"]
    assert text("<p data-class='footer'>a</p>") == ["a"]


def test_parts_of_names_are_furniture():
    for name in ("cookie-notice", "site-footer", "comment-list", "advert-box", "Ad-Banner", "social_links"):
        page = f"<div class='x {name}'><p>waste</p></div><p>Text</p>"
        assert pagetext.candidates(pagetext.lines_of(page)) == ["Text"]


def test_long_pages_take_no_quadratic_time():
    start = time.monotonic()
    pagetext.lines_of("<div>" * 20_000 + "</p></section>" * 100_000 + "<a x=\"" + "'" * 2_000_000)
    rows = ["cell"] * 20_000
    assert len(pagetext.common_lines(["a", *rows, "b"], ["c", *rows, "cell", "b"])) <= 20_001
    assert time.monotonic() - start < 60


def test_names_of_wrappers_do_not_drop_articles():
    def text(page):
        return pagetext.candidates(pagetext.lines_of(page))

    body = "<article><p>Text</p></article><p>out</p>"
    for around in ("div class='layout with-sidebar'", "div class=no-sidebar", "div id='header'", "div class='post has-comments'",
                   "div class=ad-free", "form action=/x", "div class=header-wrap", "div class='page widget'"):
        assert text(f"<{around}>{body}</{around.split()[0]}>") == ["Text"]
    assert text("<div class='layout no-sidebar'><p>Text</p></div>") == ["Text"]
    for more in ("<article class='comment'><p>me too</p></article>", "<div class='comments'><article><p>me</p></article></div>",
                 "<aside><article><p>teaser</p></article></aside>"):
        assert text(body + more) == text(more + body) == ["Text"]
    assert text("<main><article><p>Text</p><article><p>me too</p></article><p>End</p></article><p>more</p></main>") == [
        "Text", "End", "more"]
    assert text("<div class=header><main><div class=ad>buy</div><p>Text</p></main><p>menu</p></div><p>x</p>") == ["Text"]


# ---------------------------------------------------------------- licences
def test_licences(spark):
    docs = [(1, "Released under the MIT License."), (1, "Released under the MIT License."),
            (2, "foo\nLicensed under  the APACHE license, version 2.0!\nx"), (3, None), (4, ""), (5, "licence"),
            (6, "CC BY-NC 4.0"), (None, "x\n" + "y " * 50_000 + "\nReleased under the MIT License")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, segment int")
    got = sorted(map(tuple, licences.scan(df).collect()), key=str)
    db = duckdb.connect()
    db.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    assert got == sorted(db.execute(licences.oracle_sql()).fetchall(), key=str)
    assert {r[0] for r in got} == {1, 2, 6, None} and len([r for r in got if r[0] == 1]) == 2
    assert licences.scan(df.where("false")).collect() == []


# ---------------------------------------------------------------- mixing
@pytest.mark.parametrize("weights", [{"a": 1, "b": 2, "c": 3}, {"a": 500, "b": 499, "c": 1}, {"a": 1}])
def test_pfair_lag(weights):
    total, slots = sum(weights.values()), mixing.pfair_period(weights)
    owner = {t: s for s, ts in slots.items() for t in ts}
    assert sorted(owner) == list(range(total))
    run = dict.fromkeys(weights, 0)
    for t in range(total):
        run[owner[t]] += 1
        assert all(abs((t + 1) * w / total - run[s]) < 1 for s, w in weights.items())


def test_mixing_keeps_all_rows(spark):
    rng = random.Random(5)
    docs = [(rng.randrange(300) if rng.random() > .05 else None, rng.choice(["a", "a", "b", None]),
             None if i % 20 == 0 else "x" * rng.randint(0, 40)) for i in range(400)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, slot int")
    rows = mixing.schedule(df, {"a": 3, "b": 1, None: 2}, block_chars=50).collect()
    assert len(rows) == len(docs)
    assert all(r.release <= r.slot < r.deadline and r.block == r.offset // 50 for r in rows)
    owner = {}
    for r in rows:
        assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    lengths = defaultdict(int)
    for _, s, t in docs:
        lengths[s] += len(t or "")
    for s in lengths:
        assert max(r.offset for r in rows if r.source == s) <= lengths[s]
    mixed = mixing.mix(df, {"a": 3, "b": 1}, block_chars=50)
    assert mixed.columns == df.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, df.collect()))
    assert mixing.schedule(df.where("false")).collect() == []


# ---------------------------------------------------------------- tokens
def test_bpe_equals_library(spark):
    rng = random.Random(6)
    library = Tokenizer.from_file(VOCABULARY)
    alphabet = "abeht inreo'sl  \n\t.,!é1<|e的😀 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|> b", "a" * 5000, " " * 90 + "x", "-" * 700, "\n\n  \n a"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in bpe.token_digests(df, VOCABULARY).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(df, VOCABULARY).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_merges_that_never_arise():
    library = Tokenizer(BPE(vocab={"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5},
                            merges=[("a", "b"), ("b", "c"), ("a", "bc")]))
    labels = {i: t.encode() for t, i in library.get_vocab().items()}
    small = bpe.Automaton({"labels": labels, "special": {}, "merges": [(0, 1, 3), (1, 2, 4), (0, 4, 5)]})
    for text in ("abc", "bc", "abcabc", "cbcabcb"):
        assert small.encode_word(text.encode()) == library.encode(text).ids
        assert small.encode_words([text.encode()])[0].tolist() == library.encode(text).ids


@pytest.mark.parametrize("long_word", [0, 4, 48])
def test_words_together_equal_single_words(monkeypatch, long_word):
    monkeypatch.setattr(bpe, "LONG_WORD", long_word)
    rng = random.Random(2)
    automaton = bpe.Automaton(bpe.load_vocabulary(VOCABULARY))
    words = [bytes(rng.choice(b" aeinorst\xc3\xa9-0") for _ in range(rng.randint(1, 60))) for _ in range(900)]
    words += [b"", b" the", b"-" * 64, bytes(range(256)), *(bytes([b]) for b in range(256))]
    ids, count = automaton.encode_words(words)
    assert [p.tolist() for p in np.split(ids, np.cumsum(count)[:-1])] == [automaton.encode_word(w) for w in words]
    assert [a.tolist() for a in automaton.encode_words([])] == [[], []]


def test_arcs_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "ARCS_KEPT", 5)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    small, library = bpe.Encoder(bpe.load_vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    text = "The other theses, and those others; the athlete's thesis " * 3
    for _ in range(3):
        assert small.encode(text) == library.encode(text).ids
    assert len(small.automaton.table) <= 5


def test_batches_of_texts_equal_single_texts():
    enc, library = bpe.Encoder(bpe.load_vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    texts = ["cut off", None, "", " ", "  ", " a", "a ", "a  b", "a \n b\n", "\n x", "x \n", "<|endoftext|> a <|endoftext|>",
             "a\xa0 b", "a \xa0b", "a\x1c b", "a \x1cb", "a\u3000 b", "it's  we'll 12 3", "same words same words", "é 的 😀"]
    ids, ends = enc.encode_batch(pa.array(texts, pa.string()).slice(1))
    want = [library.encode(t or "").ids for t in texts[1:]]
    assert [part.tolist() for part in np.split(ids, ends[:-1])] == want
    assert enc.digests(ids, ends) == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
    assert [a.tolist() for a in enc.encode_batch(pa.array([], pa.string()))] == [[], []]


def test_workers_hold_little():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvwy") for _ in range(rng.randint(2, 12))) for _ in range(60_000)]
    texts = pa.array([" ".join(rng.choices(words, k=700)) for _ in range(500)])
    vocabulary = bpe.load_vocabulary(VOCABULARY)
    shipped = pickle.dumps(bpe.Encoder(vocabulary))
    del vocabulary
    gc.collect()
    tracemalloc.start()
    try:
        enc = pickle.loads(shipped)                            # what a worker gets
        batch = pa.RecordBatch.from_arrays([texts, texts], names=["id", "text"])
        n = sum(len(enc.encode_batch(b.column(1))[0]) for b in bpe._parts([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 500 * 700 and len(shipped) < 16e6 and peak < 60e6
    assert "arc" not in vars(enc.automaton)                    # no object for each token until a word is very long
    word = "-" * 30 + "Donaudampfschiff" * 8
    assert enc.encode(word) == Tokenizer.from_file(VOCABULARY).encode(word).ids


# ---------------------------------------------------------------- personal data
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    out, counts = [], []
    for kind, pattern in PATTERNS.items():
        n = 0
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return *counts, hashlib.sha256(",".join(out).encode()).hexdigest()


def test_base_spans(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("a@b.c1234 5.+()-é😀\n%_") for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    docs += [(3001, "a@b.c%x@d.e"), (3002, "4111 1111 1111 1111 x 4111-1111-1111-1112"), (3003, None), (3004, ""),
             (3005, "1" * 3000 + "." + "2" * 5), (None, "x@y.zz"), (3007, "😀😀 a@b.co 1.2.3.4"),
             (3008, "x" * 100_000 + " 1 " + "y" * 100_000 + "1-" * 30_000)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, kind string")
    found = pii.find(df)
    got = {r.doc_id: r for r in pii.digests(found).collect()}
    for key, text in docs:
        r = got[key]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == _base(text or "")
    clean = {r.doc_id: r.text for r in pii.redact(df, found).collect()}
    assert clean[3001] == "<EMAIL><EMAIL>" and clean[3002] == "<CARD> x 4111-1111-1111-1112"
    assert clean[3003] is None and clean[3007] == "😀😀 <EMAIL> <IP>" and len(clean) == len(docs)
    empty = spark.createDataFrame([], df.schema)
    assert pii.digests(pii.find(empty)).collect() == []


def test_contexts_reveal_identifiers(spark):
    docs = [(i, f"hello there mail me: u{i}@site{i % 7}.com and card no {i}x") for i in range(40)]
    docs += [(100, "blah mail me: bob42(at)home and card no 17x"), (101, "word 77 is"), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find(df)
    added = {r.doc_id: r.spans for r in pii.digests(found).where("n_found > 0").collect()}
    assert added == {100: "email:14:27"}
    clean = {r.doc_id: r.text for r in pii.redact(df, found).collect()}
    assert clean[100] == "blah mail me: <EMAIL> and card no 17x" and clean[101] == "word 77 is"


def test_identifiers_with_blanks_are_one_instance(spark):
    docs = [(i, f"word{i % 3} tel: call +1 (743) 555-38{i:02}, and on") for i in range(8)]
    docs += [(20, "we call 0171 555 1234, 17 apples"), (21, "they call 0171 555 1299\n88 on"), (22, "x=+1 (743) 555-3899"),
             (23, "then call 020 7946 0018 "), (24, "\ufdd0 then call 4111 1111 1111 1111 and 1.2.3.4 a@b.co,c@d.co")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = pii.find(df)
    spans = {r.doc_id: r.spans for r in pii.digests(found).collect()}
    assert spans[20] == "phone:8:21" and spans[21] == "phone:10:23" and spans[23] == "phone:10:23"
    clean = {r.doc_id: r.text for r in pii.redact(df, found).collect()}
    assert clean[20] == "we call <PHONE>, 17 apples" and clean[21] == "they call <PHONE>\n88 on"
    assert clean[24] == "\ufdd0 then call <CARD> and <IP> <EMAIL>,<EMAIL>"
    rows = pii._matches(df, "doc_id", "text")
    seen = {r.id: [(i.raw, i.words, i.lead, i.kind) for i in r.instances] for r in rows.collect()}
    assert seen[3] == [("+1 (743) 555-3803", "tel: call", "", "phone"), ("word0", "", "", None)]
    assert seen[22] == [("+1 (743) 555-3899", "", "x=", "phone")]
    assert [x[0] for x in seen[24]] == ["4111 1111 1111 1111", "1.2.3.4", "a@b.co", "c@d.co"]
    assert seen[24][0][1] == "then call" and seen[24][3][1:3] == ("", "")


# ---------------------------------------------------------------- fingerprints
def test_edited_texts(spark):
    rng = random.Random(8)
    docs = [(i * 3, " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 9)))
                             for _ in range(rng.randint(0, 400)))) for i in range(60)]
    docs += [(2, None), (4, ""), (5, "x"), (5, "x"), (None, "null id"), (1000, docs[50][1]), (7, "ab" * 4000)]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, side int")
    got = defaultdict(list)
    for r in phrases.compare_edited(df).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(docs)
    order = sorted((d for d in docs), key=lambda d: (d[0] is None, -(d[0] or 0)))
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        if key == 5:
            continue
        text, after, r = text or "", after or "", got[key][0]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) > 400:
            assert r.near_edited > r.near_next + 0.1 or key == 7
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints = phrases._all_fingerprints(phrases.pa.array([text, edited, after]))
        assert [p.tobytes().hex() for p in prints[:2]] == [r.fingerprint, r.edited_fingerprint]
    assert got[1000][0].fingerprint == got[150][0].fingerprint
    assert phrases.compare_edited(df.where("false")).collect() == []
    assert phrases.compare_edited(df.where("doc_id = 1000")).first().near_next == 1


def test_interior_phrases_do_not_depend_on_the_offset():
    rng = np.random.default_rng(9)
    core = rng.integers(97, 123, 3000).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, n).astype(np.uint8), core]) for n in (100, 577))
    names = [{(lv, int(x)) for _, lv, ns in phrases.parse(t, np.array([0, len(t)])) for x in ns if lv == 3}
             for t in (a, b)]
    assert len(names[0] & names[1]) > 0.85 * len(names[0])


def test_likeness_does_not_depend_on_the_length():
    rng = random.Random(12)
    for n in (300, 398, 399, 800):
        text = "".join(rng.choice("abcdefghij ") for _ in range(n))
        a, b = phrases._all_fingerprints(phrases.pa.array([text, text + "wxyz"]))
        assert phrases.likeness(a[None], b[None])[0] > 0.75


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_rows_come_in_the_mixture_order(spark, monkeypatch, tmp_path):
    docs = spark.range(160).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.repeat(F.lit(" ab"), 4000)).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 8 == 0, "b").when(F.col("id") % 8 == 1, "c").otherwise("a").alias("source"),
        F.lit(12001).cast("long").alias("n_chars"))
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.place for r in rows] == list(range(1, 161))
    at = {r.doc_id: r for r in mixing.schedule(docs).collect()}
    order = [(at[r.doc_id].slot, at[r.doc_id].offset) for r in rows]
    assert order == sorted(order)
    # Without the stage the rows come as they were written.
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] != [r.doc_id for r in rows]
    weight = {r.source: r.weight for r in at.values()}
    last = {s: max(r.slot for r in at.values() if r.source == s) for s in weight}
    slots = list(dict.fromkeys((at[r.doc_id].slot, r.source) for r in rows if at[r.doc_id].slot <= min(last.values())))
    assert len(slots) > 4
    for n in range(1, len(slots) + 1):
        assert all(abs(sum(o == s for _, o in slots[:n]) - n * w) < 1 for s, w in weight.items())


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, "other words in this one", "en", "s", 1),
            (9, text + " more", "en", "s", 1), (4, None, "en", "s", 1), (None, "no id here at all", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, df, SF).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 4, None]


def test_registered_queries_are_the_operators_in_order():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES] == list(range(1, len(registry.QUERIES) + 1))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
