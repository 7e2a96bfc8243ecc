"""Operator 9: removal of repeated byte strings by a sparse, distributed suffix array.

Every byte covered by a ``width``-byte string that also starts anywhere else
(same text included) is removed.  Sorting the suffixes of all bytes would
shuffle each byte ``width`` times, so the array is sparse, and still exact:

1. *Leading tokens.*  A window of ``width`` bytes is represented by its anchor,
   the ``gram``-byte token in it with the smallest hash (the first one on
   ties).  The choice depends on the window's bytes alone, so equal windows
   have equal anchors at equal offsets.  Neighbouring windows share anchors:
   a *run* is a range of windows with one anchor, its *context* the bytes they
   cover.  About 2 / (width - gram) of all positions are anchors.
2. Anchors whose token occurs once are done.  Where all contexts of a token
   are the same bytes, all their windows repeat.  Tokens with different
   contexts go on, one copy of each context.
3. *Sampled splitters.*  Contexts are range-partitioned by leading token; the
   splitters come from Spark's sample of the tokens.  Each bucket sorts the
   suffixes that start at its anchors, and the reversed prefixes that end
   there, by multikey quicksort on 8-byte symbols; the common prefixes of
   neighbours in both orders tell which windows repeat.  A window reaching d
   bytes left of its anchor repeats exactly if another context shares its
   prefix class at depth d and its suffix class at depth width - d.  Splitters
   lie between tokens, so no pair needs a comparison across buckets, except
   where one token has more than ``HOT_CONTEXTS`` contexts: those are compared
   window by window over all buckets (``_hot_windows``), with the same result.

Texts are handled as UTF-8 and keyed by two hashes and their length, so copies
of a text are worked on once and counted as often as they occur.  Null text is
empty and has nothing to remove; texts shorter than ``width`` keep all bytes.
Null ids, repeated rows, empty tables and extra columns are fine: one row out
for each row in.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.llm.common import (HELD, byte_table, enter, mix64, shuffle_width, slices, small_batches,
                                     text_bytes)
from featurescape.session import materialize

WIDTH, GRAM = 400, 100
STEP = 1 << 18               # window starts handled by one numpy step
BUFFER = 20_000              # contexts sorted together, at least one whole token's
HOT_CONTEXTS = 100_000       # contexts of one token beyond which it is split

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEY = ("t1", "t2", "t3")    # hashes and length of a text
_LOW = np.uint64(0xFFFFF)    # low bits that hold a position within a step


class _Hasher:
    """Rolling polynomial hashes modulo 2**64 of byte strings within one step."""

    def __init__(self, seed: int, size: int):
        self.table = byte_table(seed)
        power = np.full(size + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power)
        power[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.inverse = np.cumprod(power)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.inverse[start]


_HASHERS: dict[tuple[int, int], _Hasher] = HELD.setdefault("suffixes", {})


def _hasher(seed: int, size: int) -> _Hasher:
    if (seed, size) not in _HASHERS:
        _HASHERS[seed, size] = _Hasher(seed, size)
    return _HASHERS[seed, size]


def _rolling_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours."""
    size = 1
    while size * 2 <= span:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (span - size)], x[span - size:]) if span > size else x


def _runs(data: np.ndarray, off: np.ndarray, width: int, gram: int):
    """Runs of a batch of texts: (text, first window, bytes from there to the
    anchor, windows, token hash, context hash), as arrays."""
    span = width - gram + 1
    hasher = _hasher(11, STEP + width)
    out = []
    for s in range(0, max(0, len(data) - width + 1), STEP):
        x = data[s:s + STEP + width - 1]
        windows = len(x) - width + 1
        prefix = hasher.prefix(x)
        at = np.arange(len(x) - gram + 1)
        token = mix64((prefix[gram:] - prefix[:-gram]) * hasher.inverse[:len(at)])
        least = _rolling_min((token & ~_LOW) | at.astype(np.uint64), span)
        anchor = (least & _LOW).astype(np.int64)
        valid = np.ones(windows, bool)
        first, last = np.searchsorted(off, (s, s + windows + width), side="left")
        for end in off[max(first, 1):last]:
            valid[max(0, end - s - width + 1):max(0, end - s)] = False
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])) + 1
        lo = np.concatenate([[0], cut])
        hi = np.concatenate([cut, [windows]])                  # past the run's last window
        ok = valid[lo]
        lo, hi = lo[ok], hi[ok]
        a = anchor[lo]
        shape = ((a - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
        context = mix64(mix64(hasher.of(prefix, lo, hi - 1 + width)) + shape)
        text = np.searchsorted(off, lo + s, side="right") - 1
        out.append((text, lo + s - off[text], a - lo, hi - lo, token[a], context))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(c) for c in zip(*out)]


def _occurrences(width: int, gram: int):
    def run(batches):
        enter("suffixes")
        for batch in batches:
            data, off = text_bytes(batch.column(3))
            for i, j in slices(off):
                rows, lo, left, size, token, context = _runs(
                    data[off[i]:off[j]], off[i:j + 1] - off[i], width, gram)
                if len(rows):
                    take = pa.array(rows + i)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(take) for k in range(3)), pa.array(lo, pa.int64()),
                         pa.array(left.astype(np.int32)), pa.array(size.astype(np.int32)),
                         pa.array(token.view(np.int64)), pa.array(context.view(np.int64))],
                        names=[*_KEY, "lo", "back", "size", "token", "context"])
    return run


def _slice_contexts(width: int):
    """Cut the listed contexts out of a text."""
    def run(batches):
        for batch in batches:
            out = {"token": [], "context": [], "copies": [], "back": [], "size": [], "bytes": []}
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    for k in ("token", "context", "copies", "back", "size"):
                        out[k].append(w[k])
                    out["bytes"].append(data[w["lo"]:w["lo"] + w["size"] - 1 + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["token"], pa.int64()), pa.array(out["context"], pa.int64()),
                 pa.array(out["copies"], pa.int64()), pa.array(out["back"], pa.int32()),
                 pa.array(out["size"], pa.int32()), pa.array(out["bytes"], pa.binary())],
                names=list(out))
    return run


def multikey_order(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Order of rows by (group, symbols) by multikey quicksort: partition by one
    symbol, then go on with the next one inside each part of equals only."""
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))
    active = np.arange(len(order))
    for level in range(symbols.shape[1]):
        # positions whose part has other members
        same = np.zeros(len(active), bool)
        equal = part[active][1:] == part[active][:-1]
        same[1:] |= equal
        same[:-1] |= equal
        active = active[same]
        if not len(active):
            break
        value = symbols[order[active], level]
        by = np.lexsort((value, part[active]))
        order[active] = order[active][by]
        value, old = value[by], part[active]
        new = np.concatenate([[0], (value[1:] != value[:-1]) | (old[1:] != old[:-1])])
        # part numbers only need to differ between neighbours that differ
        part[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
    return order


def _common(order: np.ndarray, group: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Common prefix of each row in the order with the one before it; -1 between groups."""
    out = np.full(len(order), -1, np.int64)
    for s in range(1, len(order), 4096):
        a, b = order[s - 1:min(s + 4096, len(order)) - 1], order[s:s + 4096]
        differ = text[a] != text[b]
        out[s:s + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    out[new] = -1
    return out


def repeated_windows(group, copies, back, size, texts, width: int, gram: int):
    """Which windows of the contexts repeat: (context, first, last) ranges of
    windows counted from each context's start."""
    n, reach = len(group), width - gram
    right = np.zeros((n, -(-width // 8) * 8), np.uint8)
    left = np.zeros((n, -(-reach // 8) * 8), np.uint8)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        right[i, :len(b) - back[i]] = b[back[i]:]
        left[i, :back[i]] = b[:back[i]][::-1]
    by_right = multikey_order(group, right.view(">u8"))
    by_left = multikey_order(group, left.view(">u8"))
    near_right, near_left = _common(by_right, group, right), _common(by_left, group, left)
    low = back - size + 1                                      # offsets of the last and first window
    repeats = np.zeros((n, reach + 1), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach + 1):
        rows = np.flatnonzero((low <= d) & (d <= back))
        if not len(rows):
            continue
        left_class[by_left] = np.cumsum(near_left < d)
        right_class[by_right] = np.cumsum(near_right < width - d)
        key = left_class[rows] * (n + 1) + right_class[rows]
        by = np.argsort(key, kind="stable")
        equal = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(rows), bool)
        hit[1:] |= equal
        hit[:-1] |= equal
        repeats[rows[by[hit]], d] = True
    many = np.flatnonzero(copies > 1)
    offsets = np.arange(reach + 1)
    repeats[many] = (low[many, None] <= offsets) & (offsets <= back[many, None])
    padded = np.zeros((n, reach + 3), np.int8)
    padded[:, 1:-1] = repeats
    edge = np.diff(padded, axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return row, back[row] - (past - 1), back[row] - first


def _sort_buckets(width: int, gram: int):
    """Contexts, sorted by token within a range bucket -> repeated windows."""
    names = ["token", "context", "first", "last"]

    def solve(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        token, context = t["token"].to_numpy(), t["context"].to_numpy()
        row, first, last = repeated_windows(
            token, t["copies"].to_numpy(), t["back"].to_numpy().astype(np.int64),
            t["size"].to_numpy().astype(np.int64), t["bytes"].to_pylist(), width, gram)
        return pa.RecordBatch.from_arrays(
            [pa.array(token[row]), pa.array(context[row]), pa.array(first.astype(np.int32)),
             pa.array(last.astype(np.int32))], names=names)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            if held and rows >= BUFFER:
                # the open token's contexts stay together
                cut = int(np.searchsorted(token, held[-1].column("token")[-1].as_py(), side="right"))
                if cut < batch.num_rows:
                    yield solve([*held, batch.slice(0, cut)] if cut else held)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield solve(held)
    return run


def _window_hashes(width: int):
    """Two hashes of each window of a context."""
    def run(batches):
        for batch in batches:
            cols = [[], [], [], [], []]
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)
                size = len(data) - width + 1
                start = np.arange(size)
                for k, seed in ((3, 11), (4, 12)):
                    h = _hasher(seed, STEP + width)
                    cols[k].append(mix64(h.of(h.prefix(data), start, start + width)).view(np.int64))
                cols[0].append(np.full(size, batch.column("token")[i].as_py()))
                cols[1].append(np.full(size, batch.column("context")[i].as_py()))
                cols[2].append(start.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                             names=["token", "context", "at", "w1", "w2"])
    return run


def _hot_windows(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated windows of contexts whose token is too frequent for one bucket:
    windows are counted by their hashes over all buckets, combined map-side."""
    w = contexts.mapInArrow(_window_hashes(width),
                            "token long, context long, at int, w1 long, w2 long")
    w = materialize(w.join(contexts.select("token", "context", "copies"), ["token", "context"]))
    many = materialize(w.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2"))
    hit = w.join(many, ["w1", "w2"], "left_semi")
    return hit.select("token", "context", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_ranges(docs: DataFrame, text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                    hot: int = HOT_CONTEXTS) -> DataFrame:
    """(t1, t2, t3, spans): for each text (by hashes and length) with repeated
    windows, the ranges [first, last] of their starts, in bytes."""
    if not 0 < gram < width:
        raise ValueError("gram must be smaller than width")
    spark = small_batches(docs).sparkSession
    texts = _keyed(docs, text_col)
    occ = materialize(texts.where(f"octet_length(text) >= {width}").mapInArrow(
        _occurrences(width, gram),
        "t1 long, t2 int, t3 int, lo long, back int, size int, token long, context long"))
    tokens = materialize(occ.groupBy("token").agg(
        F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
        .where("n > 1").select("token", (F.col("a") != F.col("b")).alias("mixed")))
    # Written before it is grouped, so that a join with a frequent token can be split.
    runs = materialize(
        materialize(occ.join(tokens, "token"))
        .groupBy(*_KEY, "lo", "back", "size", "token", "context", "mixed")
        .agg(F.count("*").alias("copies")))
    kinds = materialize(runs.where("mixed").groupBy("token", "context").agg(
        F.sum("copies").alias("copies"),
        F.min(F.struct(*_KEY, "lo", "back", "size")).alias("at")))
    wanted = kinds.select("at.t1", "at.t2", "at.t3", F.struct(
        "token", "context", "copies", "at.lo", "at.back", "at.size").alias("w")
    ).groupBy(*_KEY).agg(F.collect_list("w").alias("wanted"))   # bounded by a text's length
    source = texts.join(materialize(wanted), list(_KEY)).select("text", "wanted", *_KEY)
    schema = "token long, context long, copies long, back int, size int, bytes binary"
    # Copies of a text each deliver their contexts; a bucket keeps one of each.
    contexts = source.select("text", "wanted").mapInArrow(_slice_contexts(width), schema)
    many = kinds.groupBy("token").count().where(F.col("count") > hot).select("token")
    many = materialize(many)
    hot_tokens = many.count()
    width_of = max(shuffle_width(spark), 1)
    if hot_tokens:
        contexts = materialize(contexts.dropDuplicates(["token", "context"]))
        plain = contexts.join(many, "token", "left_anti")
    else:
        plain = contexts
    sorted_ = (plain.repartitionByRange(width_of, "token").sortWithinPartitions("token", "context"))
    found = sorted_.mapInArrow(_once(_sort_buckets(width, gram)),
                               "token long, context long, first int, last int")
    if hot_tokens:
        found = found.unionByName(_hot_windows(contexts.join(many, "token", "left_semi"), width))
    found = materialize(found)
    place = runs.select(*_KEY, "lo", "size", "token", "context", "mixed")
    whole = place.where("not mixed").select(
        *_KEY, F.col("lo").alias("first"), (F.col("lo") + F.col("size") - 1).alias("last"))
    part = place.where("mixed").join(found, ["token", "context"]).select(
        *_KEY, (F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))
    return whole.unionByName(part).groupBy(*_KEY).agg(
        F.collect_list(F.struct("first", "last")).alias("spans"))


def _once(sort):
    """Drop repeated (token, context) rows of a sorted bucket, then sort it."""
    def distinct(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column("token").to_numpy(), batch.column("context").to_numpy()])
            new = np.concatenate([[before is None or bool((key[:, 0] != before).any())],
                                  (key[:, 1:] != key[:, :-1]).any(axis=0)])
            before = key[:, -1]
            yield batch.filter(pa.array(new))

    def run(batches):
        yield from sort(distinct(batches))
    return run


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"),
                       F.octet_length(text).alias("t3"), text.alias("text"))


def _merge(spans, width: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows whose starts lie in the ranges."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + width)
        else:
            out.append([first, last + width])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int, hot: int) -> DataFrame:
    spans = materialize(repeated_ranges(docs, text_col, width, gram, hot))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("*", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"),
                        F.octet_length("text").alias("t3"))
    return keyed.join(spans, list(_KEY), "left").select("id", "text", "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   gram: int = GRAM, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(id, kept binary, ranges array<struct<start,end>>): the bytes kept of each
    text and the byte ranges removed from it."""
    def run(batches):
        for batch in batches:
            kept, ranges = [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                cut = _merge([(s["first"], s["last"]) for s in spans.as_py() or ()], width)
                kept.append(_keep(data, cut))
                ranges.append([{"start": a, "end": b} for a, b in cut])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()),
                 pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["id", "kept", "ranges"])

    df = _with_spans(docs, id_col, text_col, width, gram, hot)
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, kept binary, ranges array<struct<start:long,end:long>>"
                         ).withColumnRenamed("id", id_col)


def _keep(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cut:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   gram: int = GRAM, hot: int = HOT_CONTEXTS) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, SHA-256 of the bytes kept."""
    def run(batches):
        for batch in batches:
            n, removed, count, digest = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                cut = _merge([(s["first"], s["last"]) for s in spans.as_py() or ()], width)
                n.append(len(data))
                removed.append(sum(b - a for a, b in cut))
                count.append(len(cut))
                digest.append(hashlib.sha256(_keep(data, cut)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    df = _with_spans(docs, id_col, text_col, width, gram, hot)
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(
        run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ).withColumnRenamed("id", id_col)
