"""Operator 10: document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into longer phrases, and so on
up to one phrase for the text.  On each level runs of one symbol become one
symbol, deterministic coin tossing reduces the symbols to labels below 16
(twice the lowest bit in which a symbol differs from the one before, plus
that bit; two rounds), and phrases begin where a label is larger than both
its neighbours.  Both steps look at a few symbols only, so equal substrings
are parsed alike except near their ends, wherever they stand.  A phrase is
named by a 64-bit hash of the names of its parts.

The fingerprint sketches the set of names from level ``LEVEL`` on, whatever
the text's length (texts of one phrase keep its name on any level): the names fall into ``BINS`` bins by hash, each bin keeps eight bits of its
smallest name, written as hex, 00 if empty.  What a run of ``RUN`` symbols
repeats counts as a phrase too, so repetitive texts resemble their parts.  The likeness of two fingerprints is
the share of their filled bins that agree: an estimate of the Jaccard
similarity of the phrase sets.  It is 1 for equal texts, and for two empty ones.

Null text is empty.  A null id comes last in the descending order; rows with
one id follow by text hash.  A table's only row is its own successor.  Rows, also
repeated ones, come back one for one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.llm.common import byte_table, enter, in_order, mix64, slices, small_batches, text_bytes

BINS = 128
LEVEL, RUN = 2, 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNIT = byte_table(21)
_VALUE = np.uint64((1 << 40) - 1)


def _toss(now, before):
    """Twice the lowest differing bit's index, plus that bit of ``now``."""
    differ = now ^ before
    low = differ & (~differ + now.dtype.type(1))
    return (np.bitwise_count(low - now.dtype.type(1)) * 2 + ((now & low) != 0)).astype(np.uint8)


_BYTE = np.arange(256, dtype=np.uint8)
_BYTE_TOSS = _toss(_BYTE[:, None], _BYTE[None, :])             # labels of byte pairs
_SMALL_TOSS = _toss(_BYTE[:, None], _BYTE[None, :])


def _starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: text starts, and local maxima of the tossed labels.
    Neighbouring symbols differ; ``first`` marks the first symbol of a text."""
    n = len(symbols)
    label = np.zeros(n, np.uint8)
    if symbols.dtype == np.uint8:
        label[1:] = _BYTE_TOSS[symbols[1:], symbols[:-1]]
    else:
        label[1:] = _toss(symbols[1:], symbols[:-1])
    label[first] = 200                                         # left edge: nothing to compare with
    again = np.zeros(n, np.uint8)
    again[1:] = _SMALL_TOSS[label[1:], label[:-1]]
    again[first] = 0
    start = np.zeros(n, bool)
    if n > 2:
        start[1:-1] = (again[1:-1] > again[:-2]) & (again[1:-1] >= again[2:])
        start[1:-1] &= ~first[2:]                              # the last symbol joins the phrase before
    start |= first
    return np.flatnonzero(start)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n + 1:
        size = max(n + 1, 1 << 16)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _POWER = np.cumprod(p)
        p[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _INVERSE = np.cumprod(p)
    return _POWER, _INVERSE


_POWER = _INVERSE = np.ones(1, np.uint64)


def _join(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Names of the phrases that begin at ``start``."""
    n = len(names)
    power, inverse = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(names * power[:n], out=prefix[1:])
    end = np.append(start[1:], n)
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def _merge_runs(symbols, names, first):
    """One symbol for each run of a symbol; its name holds the run's length."""
    new = np.ones(len(symbols), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | first[1:]
    if new.all():
        return symbols, names, first
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(symbols)))
    merged = names[at]
    long = size > 1
    merged[long] = mix64(merged[long] + size[long].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    kept = symbols[at] if symbols.dtype == np.uint8 else merged
    return kept, merged, first[at]


def _run_units(symbols, names, text, first):
    """(text, name) of what a run of RUN symbols or more repeats: a text of
    repeats shares it with every part of itself, whatever the count."""
    equal = np.zeros(len(symbols), bool)
    equal[1:] = (symbols[1:] == symbols[:-1]) & ~first[1:]
    whole = equal.copy()
    for k in range(1, RUN - 1):
        whole[k:] &= equal[:-k]
        whole[:k] = False
    at = np.flatnonzero(whole)
    return (text[at], mix64(names[at] ^ _BASE)) if len(at) else None


def parse(data: np.ndarray, off: np.ndarray):
    """(text, level, name) of the phrases of all texts, level by level, as a
    generator; a text that has become one phrase appears no more."""
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), size)
    if not len(text):
        return
    symbols, names = data, _UNIT[data]
    level = 0
    while len(names):
        first = np.ones(len(text), bool)
        first[1:] = text[1:] != text[:-1]
        unit = _run_units(symbols, names, text, first)
        if unit is not None:
            yield unit[0], LEVEL, unit[1]
        symbols, names, first = _merge_runs(symbols, names, first)
        if len(first) != len(text):
            text = _owners(text, first)
        start = _starts(symbols, first)
        names, text = _join(names, start), text[start]
        level += 1
        yield text, level, names
        alone = np.ones(len(text), bool)                       # texts of one phrase are done
        alone[1:] &= text[1:] != text[:-1]
        alone[:-1] &= text[1:] != text[:-1]
        names, text = names[~alone], text[~alone]
        symbols = names


def _owners(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts of the symbols after runs were merged: texts keep their order."""
    ids = text[np.concatenate([[True], text[1:] != text[:-1]])]
    return ids[np.cumsum(first) - 1]


def fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """BINS bytes for each text; 0 stands for an empty bin."""
    n = len(off) - 1
    out = np.zeros((n, BINS), np.uint8)
    features = []
    for text, level, names in parse(data, off):
        if level < LEVEL:
            alone = np.ones(len(text), bool)
            alone[1:] &= text[1:] != text[:-1]
            alone[:-1] &= text[1:] != text[:-1]
            text, names = text[alone], names[alone]
        f = mix64(names)
        features.append((text.astype(np.uint64) << np.uint64(47)) | (f >> np.uint64(17)))
    if features:
        key = np.sort(np.concatenate(features))                # text, bin, value: 17 + 7 + 40 bits
        place = key >> np.uint64(40)
        least = np.ones(len(key), bool)
        least[1:] = place[1:] != place[:-1]
        place = place[least].astype(np.int64)
        out.reshape(-1)[place] = ((key[least] & _VALUE) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out


def _all_fingerprints(texts: pa.Array) -> np.ndarray:
    data, off = text_bytes(texts)
    parts = [fingerprints(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices(off)]
    return np.concatenate(parts) if parts else np.zeros((0, BINS), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins filled in either fingerprint that agree, row by row."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row."""
    def run(batches):
        for b in batches:
            prints = _all_fingerprints(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p.tobytes().hex() for p in prints], pa.string())],
                names=["id", "fingerprint"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _with_next(batches):
    """Batches in which each row but the last has its successor below it."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        for s in range(0, max(t.num_rows - 1, 0), 2000):
            yield t.slice(s, min(2001, t.num_rows - s)), False
        held = t.slice(max(t.num_rows - 1, 0))
    if held is not None and held.num_rows:
        yield held, True


def _compare(batches):
    enter("phrases")
    for t, last in _with_next(batches):
        side, bucket = t["_side"].to_numpy(), t["_bucket"].to_numpy()
        texts = [x or "" for x in t["text"].to_pylist()]
        rows, after, edited = [], [], []
        for i in range(t.num_rows if last else t.num_rows - 1):
            if side[i] != 0:
                continue
            j = i + 1 if i + 1 < len(texts) and bucket[i + 1] == bucket[i] else i
            half = len(texts[i]) // 2
            rows.append(i)
            after.append(j)
            edited.append(texts[i][:len(texts[i]) - half] + texts[j][:half])
        if not rows:
            continue
        own = _all_fingerprints(pa.array(texts, pa.large_string()))
        new = _all_fingerprints(pa.array(edited, pa.large_string()))
        mine = own[rows]
        yield pa.RecordBatch.from_arrays(
            [t["id"].combine_chunks().take(pa.array(rows)),
             pa.array([len(texts[i]) for i in rows], pa.int64()),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
             pa.array([p.tobytes().hex() for p in mine]), pa.array([p.tobytes().hex() for p in new]),
             pa.array(likeness(mine, new)), pa.array(likeness(mine, own[after]))],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                   "near_edited", "near_next"])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (last half replaced by the
    start of the next document in descending id order) and their likeness."""
    src = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chained = in_order(src, [F.col("id").isNull().cast("int"), F.coalesce(-F.col("id"), F.lit(0)),
                             F.xxhash64("text"), F.octet_length("text")], wrap=True)
    return chained.mapInArrow(
        _compare, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                  "edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("id", id_col)
