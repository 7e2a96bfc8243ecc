"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from featurescape.llm import (bpe, crosstok, jaccard, langid, licences, mixing, pagetext, phrases, pii,
                              resampling, rotated, suffixes, vptree)
from featurescape.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return (langid.predict(docs, model)
            .withColumn("held_out", langid.held_out("doc_id"))
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))


def op2_page_text(spark, sf_dir):
    return pagetext.main_texts(table(spark, sf_dir, "pages"))


def op3_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_jaccard(spark, sf_dir):
    return jaccard.link_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_vptree(spark, sf_dir):
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_pii(spark, sf_dir):
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op9_repeats(spark, sf_dir):
    return suffixes.repeat_digests(table(spark, sf_dir, "documents"))


def op10_phrases(spark, sf_dir):
    return phrases.compare_edited(table(spark, sf_dir, "documents"))


def op11_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_crosstok(spark, sf_dir):
    return crosstok.digests(table(spark, sf_dir, "documents"), VOCABULARY, PIECES)


def op13_near_vectors(spark, sf_dir):
    return rotated.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language": op1_language,
    "op2_page_text": op2_page_text,
    "op3_licences": op3_licences,
    "op4_mixing": op4_mixing,
    "op5_jaccard": op5_jaccard,
    "op6_vptree": op6_vptree,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_repeats": op9_repeats,
    "op10_phrases": op10_phrases,
    "op11_resampling": op11_resampling,
    "op12_crosstok": op12_crosstok,
    "op13_near_vectors": op13_near_vectors,
}

# The other operators are tested against brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_licences": licences.oracle_sql(),
    "op13_near_vectors": rotated.oracle_sql(),
}
