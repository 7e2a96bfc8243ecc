"""Operator 11: target-distribution importance resampling over hashed n-grams.

A document's words come from an untrained ``Split`` of the tokenizers library over
its ASCII-lowered text, with their offsets.  Its features are the windows over one
to ``RUN`` consecutive words, repeats counted; a feature's bucket is the CRC-32 of
its words joined by one space, modulo ``BUCKETS``.  Two histograms over all rows,
of the documents and of the target texts, give each bucket a gain (a thousand times
the log ratio of the smoothed shares, floored); a document's weight is the sum of
its features' gains, its score the weight plus Gumbel noise drawn from its id, and
the best scores are the sample (the top-k way of drawing without replacement).

No word holds a space, so a batch's texts are cut at spaces in Arrow first and the
splitter reads each distinct piece once; a word's offset tells the piece that it
belongs to.  CRCs are taken once per distinct word from its offset pair and carried
over windows with tables of what a number of following bytes does to a CRC.
A histogram has ``BUCKETS`` rows, whatever the tables' size; it is the only thing
that reaches the driver.  Texts are read twice and never shuffled.  Scores are
ranked by a range partitioning of (score, id), counts per partition giving the offsets.

Null, empty or wordless texts have no features and weight 0; with an empty target
T is 0 and the same formula holds.  Rows with a null id draw their noise from the
empty id and come last among ties; each repeated row is a row of its own (equal
scores in the order of id, feature count and weight).  An empty table gives an empty
result.  Other columns do not matter.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from featurescape.llm.common import enter, runs, slices, small_batches, strings, text_bytes
from featurescape.operators.ids import with_global_index
from featurescape.session import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUN = 3                     # words of the longest feature
BUCKETS = 10_000
LEAST_WORDS = 20            # documents with fewer words are not drawn
PERCENT = 5
SPLIT_CHARS = 1 << 16       # characters given to the splitter at a time


@functools.cache
def _byte_crcs() -> np.ndarray:
    """The CRC register after one byte (the usual table of 256)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


class _Shift:
    """What ``n`` zero bytes do to a CRC: a linear map over its 32 bits, kept as four
    tables of 256.  ``crc(x + y) == after(crc(x), len(y)) ^ crc(y)``."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.which = np.unique(lengths, return_inverse=True)
        step = _byte_crcs()
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = (bits >> np.uint32(8)) ^ step[bits & np.uint32(255)]
        self.tables = np.zeros((len(self.lengths), 4, 256), np.uint32)
        for i, n in enumerate(self.lengths.tolist()):
            columns, power = bits.copy(), one
            while n:                                   # square and multiply
                if n & 1:
                    columns = self._apply(power, columns)
                power = self._apply(power, power)
                n >>= 1
            for part in range(4):
                for bit in range(8):
                    on = (np.arange(256) >> bit) & 1 == 1
                    self.tables[i, part, on] ^= columns[8 * part + bit]

    @staticmethod
    def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for bit in range(32):
            out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
        return out

    def after(self, crc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """``crc`` moved on by the length of ``item`` (an index into ``lengths`` as given)."""
        t = self.which[item]
        return (self.tables[t, 0, crc & np.uint32(255)] ^ self.tables[t, 1, (crc >> np.uint32(8)) & np.uint32(255)]
                ^ self.tables[t, 2, (crc >> np.uint32(16)) & np.uint32(255)] ^ self.tables[t, 3, crc >> np.uint32(24)])


def _plus_space(crc: np.ndarray) -> np.ndarray:
    """CRC of the same bytes and one space."""
    r = ~crc
    return ~((r >> np.uint32(8)) ^ _byte_crcs()[(r ^ np.uint32(32)) & np.uint32(255)])


@functools.cache
def _splitter() -> Split:
    return Split(Regex(WORD), "removed", invert=True)


def _split_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each piece: numbers of words, their first's place in the list of
    all words, and that list.  The splitter reads pieces joined by spaces."""
    split = _splitter()
    count = np.zeros(len(pieces), np.int64)
    words: list[str] = []
    ends = np.cumsum([len(p) + 1 for p in pieces], dtype=np.int64) if pieces else np.zeros(0, np.int64)
    i = 0
    while i < len(pieces):
        base = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + SPLIT_CHARS, side="right")))
        found = split.pre_tokenize_str(" ".join(pieces[i:j]))
        if found:
            starts = np.array([at[0] for _, at in found], np.int64) + base
            count[i:j] = np.bincount(np.searchsorted(ends, starts, side="right") - i, minlength=j - i)
            words += [w for w, _ in found]
        i = j
    return count, np.cumsum(count) - count, words


def features(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text of a batch, and for runs of 1, 2, 3 words the buckets of
    all features with the row that each belongs to."""
    raw, offsets = text_bytes(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    parts = pc.split_pattern(strings(raw, offsets), " ")
    flat = parts.flatten().dictionary_encode()
    per_piece, first, words = _split_pieces(flat.dictionary.to_pylist())
    codes = flat.indices.to_numpy(zero_copy_only=False)
    bounds = parts.offsets.to_numpy(zero_copy_only=False)
    bounds = bounds - bounds[0]
    # The word sequence of all rows, as numbers of distinct words.
    number: dict[str, int] = {}
    named = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    sequence = named[runs(first[codes], per_piece[codes])]
    before = np.concatenate([[0], np.cumsum(per_piece[codes])])
    row_ends = before[bounds]
    n_words = np.diff(row_ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    raw = [w.encode() for w in number]
    crcs = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    shift = _Shift(np.fromiter(map(len, raw), np.int64, len(raw)))
    out, crc = [], crcs[sequence]
    out.append((crc % np.uint32(BUCKETS), row))
    for size in range(2, RUN + 1):
        if len(crc) < 2:
            out.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
            crc = crc[:0]
            continue
        following = sequence[size - 1:]
        crc = shift.after(_plus_space(crc[:-1]), following) ^ crcs[following]
        inside = row[:len(crc)] == row[size - 1:]
        out.append((crc[inside] % np.uint32(BUCKETS), row[:len(crc)][inside]))
    return n_words, out


def _pieces(batch: pa.RecordBatch):
    """Parts of a batch that hold a few MB of text (column 0)."""
    _, offsets = text_bytes(batch.column(0))
    for i, j in slices(offsets):
        yield batch.slice(i, j - i)


def histogram(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket.  Each task sends one row per bucket."""

    def count(batches):
        enter("resampling")
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _pieces(batch):
                for buckets, _ in features(part.column(0))[1]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    rows = (small_batches(texts).select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())       # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket from the histograms of source and target."""
    held, wanted = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * held / ((s + 1.0) * wanted)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""

    def run(batches):
        enter("resampling")
        for batch in batches:
            for part in _pieces(batch):
                n_words, found = features(part.column(0))
                n = np.zeros(len(n_words), np.int64)
                weight = np.zeros(len(n_words), np.int64)
                for buckets, row in found:
                    ends = np.searchsorted(row, np.arange(len(n_words) + 1))
                    n += np.diff(ends)
                    weight += np.diff(np.concatenate([[0], np.cumsum(gains[buckets])])[ends])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight)],
                    names=["id", "n_words", "n_features", "weight"])

    src = small_batches(docs).select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
            .withColumnRenamed("id", id_col))


def noise(key, seed: int = 42):
    """Gumbel noise in thousandths, from the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_features, weight, score and rank; ``percent`` of the rows
    with ``least_words`` words or more are drawn, the others' rank is null."""
    gains = bucket_gains(histogram(docs, text_col), histogram(target, text_col))
    scored = materialize(weigh(docs, gains, id_col, text_col)
                         .withColumn("score", F.col("weight") + noise(F.col(id_col), seed)))
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    key = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = with_global_index(scored.where(eligible), key, "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    columns = [id_col, "n_features", "weight", "score"]
    return (ranked.select(*columns, rank.alias("rank"), "n_words")
            .unionByName(scored.where(~eligible).select(*columns, F.lit(None).cast("long").alias("rank"), "n_words")))
