"""Operator 1: language identification by averaged hashed subword embeddings.

A text's features are the 3- and 4-byte grams of its lower-cased letters
(everything that is no letter is a word boundary), hashed into ``BUCKETS``
buckets.  Each bucket has an embedding; a text is the mean of its grams'
embeddings, classified by a linear softmax.  Both layers are trained together
by stochastic gradient descent in numpy on a bounded sample: ``QUOTA`` rows of
each label, the smallest by a hash of the id.  A fifth of the sample is kept
back to fit the softmax temperature and the rejection score: the documented
share ``REJECT_RATE`` of rightly classified texts falls below it.

As mean and softmax input are linear, the trained layers collapse to one
table of BUCKETS x labels, and prediction adds table rows over the whole text.

Null text, and text without a letter, is ``und`` with score 0.  With no labelled
row everything is ``und``.  Rows come back one for one, in any order; repeated
rows, ties (the label that sorts first wins) and extra columns are harmless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurescape.llm.common import enter, small_batches, text_bytes

BUCKETS = 1 << 13
WIDTH = 16                  # embedding width
QUOTA = 600                 # training rows of each label at most
MAX_LABELS = 400            # labels learned at most (the most frequent ones)
EPOCHS, BATCH, RATE = 30, 32, 4.0
REJECT_RATE = 0.001
CHUNK = 1 << 20             # bytes handled by one numpy step

_KEEP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_SHIFT = np.uint32(32 - 13)


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of each text between two spaces, and their offsets."""
    if column.null_count:
        column = column.fill_null("")
    column = pc.utf8_lower(column.cast(pa.large_string()))
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    data, off = text_bytes(pc.binary_join_element_wise(space, column, space, none))
    return _KEEP[data], off


def _grams(data: np.ndarray):
    """Chunks of (start, gram buckets); BUCKETS stands for 'no gram here'.
    Spaces at both ends of a text keep grams from crossing into the next."""
    tail = np.full(3, 32, np.uint8)
    for s in range(0, len(data), CHUNK):
        part = data[s:s + CHUNK + 3]
        if s + CHUNK + 3 > len(data):
            part = np.concatenate([part, tail])[:min(CHUNK, len(data) - s) + 3]
        x = part.astype(np.uint32)
        a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
        three = (a << np.uint32(16)) | (b << np.uint32(8)) | c
        four = (three << np.uint32(8)) | d
        in_word = b != 32
        h3 = np.where(in_word, (three * np.uint32(0x9E3779B1)) >> _SHIFT, BUCKETS)
        h4 = np.where(in_word & (c != 32), (four * np.uint32(0x85EBCA77)) >> _SHIFT, BUCKETS)
        yield s, h3, h4


def _sums(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per text the sum of the table rows of its grams; last column: number of grams."""
    labels = table.shape[1]
    full = np.zeros((labels + 1, BUCKETS + 1))
    full[:labels, :BUCKETS] = table.T
    full[labels, :BUCKETS] = 1
    out = np.zeros((len(off) - 1, labels + 1))
    for s, h3, h4 in _grams(data):
        first = int(np.searchsorted(off, s, side="right")) - 1
        last = int(np.searchsorted(off, s + len(h3), side="left"))
        at = np.maximum(off[first:last] - s, 0)
        for k in range(labels + 1):
            out[first:last, k] += np.add.reduceat(full[k][h3] + full[k][h4], at)
    return out


def _no_letter(text: str | None) -> bool:
    return not text or not any(c.isalpha() for c in text)


def _feature_rows(batches):
    """(label, gram buckets, their shares) of each sampled row, at most BUCKETS pairs."""
    for batch in batches:
        data, off = _padded(batch.column(1))
        keys, shares = [], []
        for i in range(batch.num_rows):
            counts = np.zeros(BUCKETS + 1)
            for _, h3, h4 in _grams(data[off[i]:off[i + 1]]):
                counts += np.bincount(h3, minlength=BUCKETS + 1) + np.bincount(h4, minlength=BUCKETS + 1)
            counts[BUCKETS] = 0
            key = np.flatnonzero(counts)
            keys.append(key.astype(np.uint16).tobytes())
            shares.append((counts[key] / max(counts.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(shares, pa.binary())],
            names=["label", "keys", "shares"])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, bytes, bytes]], seed: int = 7) -> dict | None:
    """Train on (label, keys, shares) rows in their given order."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, keys, shares) in enumerate(rows):
        x[i, np.frombuffer(keys, np.uint16)] = np.frombuffer(shares, np.float32)
    y = np.array([labels.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 * len(labels) else np.zeros(len(rows), bool)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    fit, eye = np.flatnonzero(~held), np.eye(len(labels), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(fit), BATCH):
            if i == 0:
                rng.shuffle(fit)
            b = fit[i:i + BATCH]
            xb = x[b]
            hidden = xb @ embed
            error = (_softmax(hidden @ out + bias) - eye[y[b]]) / len(b)
            into = error @ out.T
            out -= rate * (hidden.T @ error)
            bias -= rate * error.sum(axis=0)
            seen = np.flatnonzero(xb.any(axis=0))
            embed[seen] -= rate * 50 * (xb[:, seen].T @ into)  # a gram has a small share of a text
    table = (embed @ out).astype(np.float64)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    z = x[check] @ table + bias

    def loss(t):
        p = _softmax(z / t)
        return -np.log(np.maximum(p[np.arange(len(check)), y[check]], 1e-12)).mean()

    temperature = min(2.0 ** np.arange(-1, 5, 0.25), key=loss)
    p = _softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    reject = min(0.5, float(np.quantile(right, REJECT_RATE))) if len(right) else 0.0
    return {"labels": labels, "table": table / temperature, "bias": bias.astype(np.float64) / temperature,
            "reject_below": reject}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "lang") -> dict | None:
    """Model of the labelled rows with non-null id and text (bounded sample)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      F.col(label_col).alias("label")).where(
        "id is not null and text is not null and label is not null")
    labels = (src.groupBy("label").count().orderBy(F.desc("count"), "label")
              .limit(MAX_LABELS).select("label"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = (src.select("id", "label").join(F.broadcast(labels), "label", "left_semi")
              .withColumn("n", F.row_number().over(order)).where(F.col("n") <= QUOTA).select("id"))
    # At most MAX_LABELS * QUOTA ids and at most BUCKETS pairs of numbers a row.
    rows = (src.join(F.broadcast(chosen.distinct()), "id", "left_semi")
            .withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("label")))
            .where("n = 1").withColumn("h", F.xxhash64("id", "label"))
            .select("label", "text", "h", "id"))
    feats = rows.select("label", "text").mapInArrow(
        _feature_rows, "label string, keys binary, shares binary").collect()
    return train(sorted((r["label"], bytes(r["keys"]), bytes(r["shares"])) for r in feats))


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of each row; ``rejected`` is true for
    ``und`` and for scores below the calibrated rejection score."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    if model is None:
        return src.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"),
                          F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shipped = small_batches(src).sparkSession.sparkContext.broadcast(model)   # BUCKETS x labels numbers

    def run(batches):
        enter("langid")
        for batch in batches:
            lang, score, rejected = _predict(batch.column(1), shipped.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean"
                          ).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected (none without a model)."""
    if model is None:
        return docs.where("false")
    shipped = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        enter("langid")
        for batch in batches:
            rejected = _predict(batch.column(at), shipped.value)[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def _predict(texts: pa.Array, model: dict):
    """(label, score, rejected) of each text."""
    labels = np.array(model["labels"], object)
    if not len(texts):
        return labels[:0], np.zeros(0), np.zeros(0, bool)
    data, off = _padded(texts)
    sums = _sums(data, off, model["table"])
    p = _softmax(sums[:, :-1] / np.maximum(sums[:, -1], 1)[:, None] + model["bias"])
    best = p.argmax(axis=1)
    score, lang = p[np.arange(len(p)), best], labels[best]
    for i in np.flatnonzero(_ascii_letters(data, off) == 0):   # perhaps letters of other scripts
        if _no_letter(texts[int(i)].as_py()):
            score[i], lang[i] = 0.0, "und"
    return lang, score, (lang == "und") | (score < model["reject_below"])


def _ascii_letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """ASCII letters of each padded text."""
    if len(off) == 1:
        return np.zeros(0, np.int64)
    return np.add.reduceat(((data < 128) & (data != 32)).astype(np.int32), off[:-1])


def held_out(id_column) -> F.Column:
    """Remainder 1 of crc32(id as text) modulo 3; false for a null id."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))
