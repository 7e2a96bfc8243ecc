"""Operator 12: alignment of two tokenizers' tokens over the bytes of a text.

Side A is a byte-level BPE (a tokenizers JSON file), side B a sentencepiece model.
Both read a space and the text, special tokens' strings being plain text; a token
is the byte range that its entry spells.  Per batch of documents, each side is a table
of (document, start) and pandas ``merge_asof`` finds, keyed by document, the other
side's token that covers each token start.  Of two overlapping tokens the later start
lies in the other one, so both directions together give every overlap, and only equal
starts come twice.  Where a token starts exactly at the other's start both sides ended
before it: these places cut the tokens into groups.

Tokens are not asked for text by text: no merge of either vocabulary spans a space
between two words (checked when a vocabulary is loaded), so a batch's distinct words
are encoded, many to a call, and the documents' token tables are gathered from them.

``align`` gives the tokens, links and groups of each document.  ``digests`` adds what
depends on the corpus, how often each id pair is linked anywhere and whether that
is the most for its B id: a batch is one row that holds its distinct pairs with counts and
each document's pairs as places among them; the pairs alone are shuffled and summed,
come back to their batch, and documents are settled there.  Texts and tokens are never
shuffled, no group is larger than a batch (``BATCH_BYTES`` of text, or one text), and a
pair that every batch holds is one row per batch.

Null and empty texts, and those whose tokens do not spell the space and the text
on both sides, have no tokens, links or groups: counts 0, digest ''.  Repeated rows
count as often as they occur.  Rows come back one for one, with any id, null too; other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurescape.llm.bpe import PRE_SPLIT, byte_alphabet
from featurescape.llm.common import HELD, enter, runs, slices, small_batches, strings, text_bytes
from featurescape.session import materialize

BATCH_BYTES = 8 << 20       # text of one batch row
STEP_BYTES = 2 << 20        # text aligned by one merge_asof
WORDS_A_CALL = 4096         # distinct words given to a tokenizer at a time

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_SPACE} | {_SPACE}|^ | $"            # a space beside white space or at an end
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Side:
    """A tokenizer as ids of words and bytes of ids."""

    def __init__(self, raw: list[bytes], ids):
        self.raw = raw
        self.length = np.array([len(r) for r in raw], np.int64)
        self.ids = ids                            # of a text, to which a space is added in front

    def spelled(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, each word's first place there and number of ids, and whether
        they spell it."""
        pool, at = [], 0
        first, count = np.zeros((2, len(words)), np.int64)
        good = np.ones(len(words), bool)
        alone = [i for i, w in enumerate(words) if not w or w != w.strip()]      # odd white space
        plain = np.delete(np.arange(len(words)), alone)
        for k in range(0, len(plain), WORDS_A_CALL):
            block = plain[k:k + WORDS_A_CALL]
            held = [words[i] for i in block.tolist()]
            text = " ".join(held)
            ids = np.array(self.ids(text), np.int64)
            ends = np.cumsum(self.length[ids])
            wanted = np.cumsum(np.fromiter(map(len, map(str.encode, held)), np.int64, len(held)) + 1)
            cut = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[cut] == wanted).all() \
                    and self.spelled(ids) == b" " + text.encode():
                count[block] = np.diff(cut, prepend=-1)
                first[block] = at + cut + 1 - count[block]
                pool.append(ids)
                at += len(ids)
            else:                                 # some word changed in encoding
                alone += block.tolist()
        for i in alone:
            ids = np.array(self.ids(words[i]), np.int64)
            good[i] = self.spelled(ids) == b" " + words[i].encode()
            first[i], count[i] = at, len(ids)
            pool.append(ids)
            at += len(ids)
        return np.concatenate(pool) if pool else np.zeros(0, np.int64), first, count, good


def _keep_words_apart(raw: list[bytes]) -> None:
    """No token may hold a space behind a character that is not white space."""
    if any(re.search(r"\S ", r.decode("utf-8", "replace")) for r in raw):
        raise ValueError("a token spans a space between words")


def byte_level(data: bytes) -> Side:
    """Side A from a tokenizers JSON file: byte-level BPE whose ids follow its merges,
    which is what encoding by ranks needs."""
    held = json.loads(data)
    model, pre = held["model"], held.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or held.get("normalizer") or pre.get("type") != "ByteLevel" \
            or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE vocabulary")
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:])):
        raise ValueError("ids do not follow the merges")
    special = {t["id"]: t["content"].encode() for t in held.get("added_tokens", [])}
    alphabet = byte_alphabet()
    raw = [b""] * (1 + max([*vocabulary.values(), *special]))
    for token, i in vocabulary.items():
        raw[i] = special[i] if i in special else bytes(alphabet[c] for c in token)
    _keep_words_apart(raw)
    ranks = {r: i for i, r in enumerate(raw) if r and i not in special}
    encoding = tiktoken.Encoding("byte_level", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    for i, r in special.items():
        raw[i] = r
    return Side(raw, lambda text: encoding.encode_ordinary(" " + text))


def sentence_pieces(data: bytes) -> Side:
    """Side B from a sentencepiece model, which adds the space itself."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    raw = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")                       # spells nothing, so a text with it is left out
        else:
            raw.append(piece.replace("▁", " ").encode())
    _keep_words_apart(raw)
    return Side(raw, model.encode)


_SIDES: dict[str, tuple] = HELD.setdefault("crosstok", {})


def _sides(key: str, shipped) -> tuple[Side, Side]:
    enter("crosstok")
    if key not in _SIDES:
        _SIDES.clear()
        a, b = shipped.value
        _SIDES[key] = byte_level(a), sentence_pieces(b)
    return _SIDES[key]


class Aligned:
    """Tokens of a batch of texts on both sides, and what covers what."""

    def __init__(self, texts: pa.Array, sides: tuple[Side, Side]):
        self.n = len(texts)
        codes, per_row, words = _words(texts)
        self.ids, self.row, starts = [], [], []
        sets = [side.words(words) for side in sides]
        row = np.repeat(np.arange(self.n), per_row)
        bad = np.bincount(row[~(sets[0][3] & sets[1][3])[codes]], minlength=self.n) > 0
        codes, row = codes[~bad[row]], row[~bad[row]]
        for side, (ids, first, count, _) in zip(sides, sets):
            held = ids[runs(first[codes], count[codes])]
            size = side.length[held]
            self.ids.append(held)
            self.row.append(np.repeat(row, count[codes]))
            starts.append(np.cumsum(size) - size)
        frames = [pd.DataFrame({"doc": r, "start": s, "at": np.arange(len(s))}) for r, s in zip(self.row, starts)]
        # The token of the other side that covers each token's start.
        self.cover = [pd.merge_asof(frames[i][["doc", "start"]], frames[1 - i], on="start", by="doc")["at"]
                      .to_numpy(np.int64) if len(frames[i]) else np.zeros(0, np.int64) for i in (0, 1)]
        self.opens = [starts[i] == starts[1 - i][self.cover[i]] for i in (0, 1)]     # a group starts here
        self.group = [np.cumsum(o) - 1 for o in self.opens]
        self.starts = starts

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Token places (a, b) of all overlaps: both directions, equal starts once."""
        later = np.flatnonzero(~self.opens[1])
        return (np.concatenate([np.arange(len(self.ids[0])), self.cover[1][later]]),
                np.concatenate([self.cover[0], later]))

    def count(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=self.n).astype(np.int64)

    def written(self, spellings: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3`` ('' without tokens)."""
        a, b = self.ids
        total = len(a) + len(b)
        order = np.zeros(total, np.int64)
        groups = int(self.group[0][-1]) + 1 if len(a) else 0
        first = [np.searchsorted(g, np.arange(groups + 1)) for g in self.group]
        place = [np.arange(len(a)) + first[1][self.group[0]], np.arange(len(b)) + first[0][self.group[1] + 1]]
        for side, (ids, where, sep) in enumerate(zip((a, b), place, (b"|", b";"))):
            last = np.append(self.opens[side][1:], True)
            order[where] = np.where(last, 2 * side + 1, 2 * side) * spellings[0] + ids
        table, size = spellings[1], spellings[2]
        flat = table[order].reshape(-1)
        flat = flat[flat != 0].tobytes()
        per_row = np.bincount(np.concatenate(self.row), minlength=self.n)
        ends = np.concatenate([[0], np.cumsum(size[order])])[np.concatenate([[0], np.cumsum(per_row)])]
        view = memoryview(flat)
        return [hashlib.sha256(view[i:j - 1]).hexdigest() if j > i else ""
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _spellings(sides: tuple[Side, Side]):
    """Decimal ids with each separator that may follow, as rows of a byte table:
    blocks for A and ',', A and '|', B and ',', B and ';'."""
    width = max(len(s.raw) for s in sides)
    texts = [f"{i}{sep}".encode() for sep in (",", "|", ",", ";") for i in range(width)]
    size = np.array([len(t) for t in texts], np.int64)
    table = np.array(texts, dtype=f"S{size.max()}")
    return width, table.view(np.uint8).reshape(len(texts), -1), size


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Each text cut at single spaces between words: places in the list of
    distinct words, words of each text, and that list.  Empty texts have none."""
    raw, offsets = text_bytes(texts)
    column = strings(raw, offsets)
    empty = np.diff(offsets) == 0
    odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False).astype(bool) & ~empty
    parts = pc.split_pattern(column, " ")
    bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    pool = [flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    first, count = bounds[:-1] - bounds[0], np.diff(bounds)
    if odd.any():
        number = {w: i for i, w in enumerate(words)}
        at = len(pool[0])
        for i in np.flatnonzero(odd).tolist():
            cut = [number.setdefault(w, len(number)) for w in _CUT.split(column[i].as_py())]
            pool.append(np.array(cut, np.int64))
            first[i], count[i] = at, len(cut)
            at += len(cut)
        words = list(number)
    count = np.where(empty, 0, count)
    codes = np.concatenate(pool)[runs(first, count)]
    used = np.bincount(codes, minlength=len(words)) > 0
    if not used.all():                            # words of texts that were cut anew
        words = [w for w, u in zip(words, used.tolist()) if u]
        codes = (np.cumsum(used) - 1)[codes]
    return codes, count, words


def _ship(df: DataFrame, path_a: str, path_b: str):
    # Two vocabulary files (2 MB together), read by the driver alone.
    with open(path_a, "rb") as a, open(path_b, "rb") as b:
        return small_batches(df).sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _source(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    src = df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    return src, src.schema["id"].dataType.simpleString()


def _steps(batch: pa.RecordBatch, limit: int):
    _, offsets = text_bytes(batch.column(0))
    for i, j in slices(offsets, limit):
        yield batch.slice(i, j - i), int(offsets[j] - offsets[i])


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a_ids, b_ids, links (places of overlapping tokens, by a and b) and
    groups (ids of both sides between common ends)."""
    shipped, key = _ship(df, path_a, path_b), f"{path_a}\n{path_b}"
    src, kind = _source(df, id_col, text_col)

    def run(batches):
        sides = _sides(key, shipped)
        for batch in batches:
            for part, _ in _steps(batch, STEP_BYTES):
                found = Aligned(part.column(0), sides)
                rows = np.arange(found.n + 1)
                ends = [np.searchsorted(r, rows) for r in found.row]
                la, lb = found.links()
                order = np.lexsort((lb, la))
                la, lb = la[order], lb[order]
                link_ends = np.searchsorted(found.row[0][la], rows)
                out = []
                for i in range(found.n):
                    a, b = (slice(e[i], e[i + 1]) for e in ends)
                    held = [np.split(ids[s], np.flatnonzero(o[s])[1:]) for ids, o, s in
                            zip(found.ids, found.opens, (a, b))] if a.stop > a.start else [[], []]
                    link = slice(link_ends[i], link_ends[i + 1])
                    out.append((found.ids[0][a].tolist(), found.ids[1][b].tolist(),
                                [{"a": x, "b": y} for x, y in zip((la[link] - a.start).tolist(),
                                                                  (lb[link] - b.start).tolist())],
                                [{"a": x.tolist(), "b": y.tolist()} for x, y in zip(*held)]))
                cols = list(zip(*out)) if out else [()] * 4
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(cols[0], ints), pa.array(cols[1], ints),
                     pa.array(cols[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                     pa.array(cols[3], pa.list_(pa.struct([("a", ints), ("b", ints)])))],
                    names=["id", "a_ids", "b_ids", "links", "groups"])

    return src.mapInArrow(
        run, f"id {kind}, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, "
             "groups array<struct<a:array<int>,b:array<int>>>").withColumnRenamed("id", id_col)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class _BatchRow:
    """What one row of the batch table collects."""

    def __init__(self, name: int, width: int):
        self.name, self.width, self.bytes, self.rows = name, width, 0, 0
        self.ids, self.digest = [], []
        self.counts = {c: [] for c in _COUNTS}
        self.entries, self.pairs, self.times = [], [], []

    def add(self, ids: pa.Array, found: Aligned, spellings, n_bytes: int) -> None:
        a, b = found.links()
        row = found.row[0][a]
        pair = found.ids[0][a] * self.width + found.ids[1][b]
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        new = np.append(True, (np.diff(pair) != 0) | (np.diff(row) != 0))[:len(pair)]
        at = np.flatnonzero(new)
        self.pairs.append(pair[at])
        self.times.append(np.diff(np.append(at, len(pair))).astype(np.uint32))
        self.entries.append(found.count(row[at]))
        values = [found.count(found.row[0]), found.count(found.row[1]),
                  found.count(found.row[0][found.opens[0]]), found.count(row)]
        for name, value in zip(_COUNTS, values):
            self.counts[name].append(value)
        self.digest += found.written(spellings)
        self.ids.append(ids)
        self.bytes += n_bytes
        self.rows += found.n

    def row(self) -> pa.RecordBatch:
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        distinct, at = np.unique(pairs, return_inverse=True)
        total = np.bincount(at, weights=times, minlength=len(distinct)).astype(np.int64)
        step = np.diff(at, prepend=0).astype(np.int32)

        def one(values):
            return pa.array([values])

        def packed(values):
            return pa.array([pa.compress(values.tobytes(), codec="zstd", asbytes=True)], pa.binary())

        ids = pa.chunked_array(self.ids).combine_chunks()
        cols = {"batch": pa.array([self.name]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        cols |= {c: one(np.concatenate(v)) for c, v in self.counts.items()}
        cols |= {"digest": pa.array([self.digest], pa.list_(pa.string())), "entries": one(np.concatenate(self.entries)),
                 "steps": packed(step), "times": packed(times), "pairs": one(distinct), "totals": one(total)}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def batch_table(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The batches as rows, and the factor of A ids in a pair's number."""
    shipped, key = _ship(df, path_a, path_b), f"{path_a}\n{path_b}"
    src, kind = _source(df, id_col, text_col)
    width = len(sentence_pieces(shipped.value[1]).raw)

    def run(batches):
        sides = _sides(key, shipped)
        spellings = _spellings(sides)
        name = TaskContext.get().partitionId() << 32
        held = _BatchRow(name, width)
        for batch in batches:
            for part, n_bytes in _steps(batch, STEP_BYTES):
                held.add(part.column(1), Aligned(part.column(0), sides), spellings, n_bytes)
                if held.bytes >= BATCH_BYTES:
                    yield held.row()
                    name += 1
                    held = _BatchRow(name, width)
        if held.rows:
            yield held.row()

    longs = "".join(f", {c} array<long>" for c in _COUNTS)
    return materialize(src.mapInArrow(
        run, f"batch long, ids array<{kind}>{longs}, digest array<string>, entries array<long>, "
             "steps binary, times binary, pairs array<long>, totals array<long>")), width


def digests(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    batches, width = batch_table(df, path_a, path_b, id_col, text_col)
    kind = batches.schema["ids"].dataType.elementType.simpleString()
    found = batches.select("batch", F.explode(F.arrays_zip("pairs", "totals")).alias("p")).select(
        "batch", F.col("p.pairs").alias("pair"), F.col("p.totals").alias("n"))
    # At most one row for each A id in a window: bounded by the vocabulary.
    most = F.max("n").over(Window.partitionBy(F.col("pair") % width))
    everywhere = found.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("best", F.col("n") == most)
    known = found.drop("n").join(everywhere, "pair").groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("known"))
    settled = batches.drop("pairs", "totals").join(known, "batch", "left")

    def run(parts):
        enter("crosstok")
        for part in parts:
            for r in range(part.num_rows):
                row = {c: part.column(i)[r] for i, c in enumerate(part.schema.names)}
                entries = np.array(row["entries"].values)
                size = 4 * int(entries.sum())

                def unpacked(name, kind):
                    return np.frombuffer(pa.decompress(row[name].as_py(), decompressed_size=size, codec="zstd")
                                         if size else b"", kind)

                ends = np.concatenate([[0], np.cumsum(entries)])
                best = total = np.zeros(len(entries), np.int64)
                if size:
                    held = row["known"].values
                    n, is_best = (np.array(held.field(i)) for i in (1, 2))
                    at, times = np.cumsum(unpacked("steps", np.int32)), unpacked("times", np.uint32).astype(np.int64)
                    best, total = (np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
                                   for v in (times * is_best[at], times * n[at]))
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values, *[row[c].values for c in _COUNTS], pa.array(best), pa.array(total),
                     row["digest"].values],
                    names=["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    counts = ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
    return settled.mapInArrow(run, f"id {kind}, {counts}, groups_sha256 string").withColumnRenamed("id", id_col)
