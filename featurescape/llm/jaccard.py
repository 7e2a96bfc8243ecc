"""Operator 5: n-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct word shingles.  Documents
with equal sets form one class; classes link when the Jaccard similarity of
their sets reaches the threshold, and components of links get their smallest
document id.

Candidates.  Tokens are ordered by class (rare before frequent), then by hash.
Sets that reach the threshold and share at least k tokens share k tokens within
their first ``n - ceil(t n) + k`` ones (the prefix extended by k - 1).  So each
class indexes, for k = 2, every rare token of that prefix alone and every pair
of its frequent tokens: if one of the two shared tokens is rare the single
token meets, else the pair does.  Sets above ``PAIRS_UP_TO`` tokens index
their frequent tokens singly (sets between t * PAIRS_UP_TO and that do both),
so no set has more than a few hundred keys beyond its prefix.  Whether a token
is frequent comes from a count sketch of fixed size over all documents, limited
to the low end of the hash range, where prefixes lie; the order is the same
for all documents, so any error of the sketch costs time only.

Verification.  Members of a key are first compared with one hub each (the
member with the smallest share of rare tokens), not with each other.  After the
links' components are known, members of a key that are still in different
components are compared pair by pair, a hashed share of the pairs first, then all
that are left, so no link between different components is missed.  Each class carries
256 parity bits of its set (large ones 4096 more), whose difference bounds the
overlap from above; pairs that pass these bounds are decided by the exact overlap of the whole sets.

Defined results: null or word-less text has an empty set, linked with nothing
(its component is its own id).  Texts with fewer words than a shingle hold one
token, the whole sequence.  Rows with a null id count as documents without
giving a component its id.  Repeated rows come back as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.llm.common import byte_table, enter, mix64, slices, small_batches, text_bytes
from featurescape.llm.components import components
from featurescape.session import drop_tables, materialize

K = 2                        # tokens of a combination
PAIRS_UP_TO = 150            # larger sets index frequent tokens singly
COUNTERS = 1 << 21           # of the sketch: 4 MB a task, merged; 256 KB of flags sent out
BLOCK = 1 << 16
COUNTED = 0.3                # share of the hash range that is counted
FREQUENT = 48                # documents from which a token is frequent, at least
FIRST_PAIRS = (64, 8, 1)     # one pair of members in so many is compared, in turn
SLICE = 1 << 19              # bytes of text shingled at a time
WIDE_BITS = 4096             # of the second signature
WIDE_FROM = 400              # tokens from which a set has one
BROADCAST_ROWS = 1_000_000   # keys of 16 bytes; above, a shuffle join is planned

_SIGN = ["w0", "w1", "w2", "w3"]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNIT = byte_table(31)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = _INVERSE = np.ones(1, np.uint64)


def _powers(n: int):
    global _POWER, _INVERSE
    if len(_POWER) < n + 1:
        p = np.full(max(n + 1, 1 << 20), _BASE, np.uint64)
        p[0] = 1
        _POWER = np.cumprod(p)
        p[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _INVERSE = np.cumprod(p)
    return _POWER, _INVERSE


def _sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (texts end in a space)."""
    space = _SPACE[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~space
    edge = np.diff(inside, append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_UNIT[_LOWER[data]] * power[:len(data)], out=prefix[1:])
    word = mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, off)
    shingle = _fold(word, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(shingle[a:b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(_fold(word[a:b], b - a)[:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fold(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; the length goes into the hash."""
    n = max(len(word) - size + 1, 0)
    h = np.full(n, int(_BASE) * size & (2 ** 64 - 1), np.uint64)
    for j in range(size):
        h = mix64(h + word[j:n + j])
    return h


def _each_set(batches, text_at: int, size: int):
    """(batch, rows from, sets) for slices of each batch."""
    enter("jaccard")
    for batch in batches:
        col = batch.column(text_at)
        col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        data, off = text_bytes(pc.binary_join_element_wise(col, space, none))
        for i, j in slices(off, SLICE):
            yield batch, i, _sets(data[off[i]:off[j]], off[i:j + 1] - off[i], size)


def _count_blocks(size: int, counters: int):
    """One row for each block of the task's sketch: (block, counts)."""
    shift, below = np.uint64(64 - int(counters).bit_length() + 1), np.uint64(int(COUNTED * 2 ** 64))

    def run(batches):
        total = np.zeros(counters, np.uint32)
        held, n = [], 0
        for _, _, sets in _each_set(batches, 0, size):
            part = [s[:np.searchsorted(s, below)] for s in sets]
            held += part
            n += sum(map(len, part))
            if n > 1 << 20:
                total += np.bincount((mix64(np.concatenate(held)) >> shift).astype(np.int64),
                                     minlength=counters).astype(np.uint32)
                held, n = [], 0
        if n:
            total += np.bincount((mix64(np.concatenate(held)) >> shift).astype(np.int64),
                                 minlength=counters).astype(np.uint32)
        block = min(BLOCK, counters)
        small = np.minimum(total, 65535).astype(np.uint16)
        salt = int(np.random.default_rng().integers(64))
        for k in range(0, counters, block):
            if total[k:k + block].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // block]), pa.array([salt]), pa.array([int(total[k:k + block].sum())]),
                     pa.array([small[k:k + block].tobytes()], pa.binary())],
                    names=["block", "salt", "tokens", "counts"])
    return run


def _add_blocks(pdf):
    total = np.zeros(len(pdf["counts"].iloc[0]) // 2, np.uint32)
    for c in pdf["counts"]:
        total += np.frombuffer(c, np.uint16)
    return pdf.iloc[:1].assign(counts=np.minimum(total, 65535).astype(np.uint16).tobytes(),
                               tokens=pdf["tokens"].sum(), salt=0)


def frequent_flags(docs: DataFrame, size: int, counters: int = COUNTERS, at_least: int = FREQUENT) -> bytes:
    """Bits of the sketch counters that hold frequent tokens."""
    schema = "block long, salt long, tokens long, counts binary"
    blocks = docs.mapInArrow(_count_blocks(size, counters), schema)
    blocks = blocks.groupBy("block", "salt").applyInPandas(_add_blocks, schema)
    rows = blocks.groupBy("block").applyInPandas(_add_blocks, schema).collect()  # one a block: 4 MB
    total = sum(r["tokens"] for r in rows)
    limit = min(max(at_least, 8 * total // counters), 65535)
    flags = np.zeros(counters, bool)
    for r in rows:
        c = np.frombuffer(r["counts"], np.uint16)
        flags[r["block"] * len(c):(r["block"] + 1) * len(c)] = c >= limit
    return np.packbits(flags, bitorder="little").tobytes()


def _least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any set it links with, at least."""
    return -(-n * percent // 100)


def _keys(tokens: np.ndarray, rare: np.ndarray, percent: int, pairs_up_to: int) -> tuple[np.ndarray, float]:
    """Index keys of one set, and the share of rare tokens in its prefix."""
    n = len(tokens)
    length = min(n, n - _least_overlap(n, percent) + min(K, n))
    head = np.flatnonzero(rare)[:length]
    tail = np.flatnonzero(~rare)[:length - len(head)]
    out = [mix64(tokens[head])]
    often = tokens[tail]
    if n > pairs_up_to * percent / 100 or n < K:
        out.append(mix64(often))
    if n <= pairs_up_to and len(often) >= K:
        i, j = np.triu_indices(len(often), 1)
        out.append(mix64(mix64(often[i] + _BASE) + often[j]))
    return np.concatenate(out), len(head) / length


def _signatures(hashes: np.ndarray, bounds: np.ndarray, bits: int = 256) -> np.ndarray:
    """Parity bits of each set, as longs: two sets' bits differ in no more places
    than the sets have tokens of their own."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * bits + (hashes & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).reshape(n, bits // 8).view(np.int64)


def _index(size: int, percent: int, pairs_up_to: int, counters: int, shipped):
    """Document rows (kind 0) and key rows (kind 1).  ``node`` is the class: a
    hash of the set below a byte with its share of rare prefix tokens."""
    shift = np.uint64(64 - int(counters).bit_length() + 1)
    names = ["kind", "id", "text_hash", "node", "n", "key", *_SIGN, "wide"]
    longs = pa.list_(pa.int64())

    def run(batches):
        flags = np.unpackbits(np.frombuffer(shipped.value, np.uint8), bitorder="little").astype(bool)
        for batch, at, sets in _each_set(batches, 2, size):
            nodes, sizes, keys, of = [], [], [], []
            wide: list = [None] * len(sets)
            bounds = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            mixed = mix64(flat)
            rare = ~flags[(mixed >> shift).astype(np.int64)]
            twice = mix64(mixed + _BASE)
            signs = _signatures(twice, bounds)
            for i, s in enumerate(sets):
                n = len(s)
                sizes.append(n)
                if not n:
                    nodes.append(None)
                    continue
                a, b = bounds[i], bounds[i + 1]
                key, share = _keys(s, rare[a:b], percent, pairs_up_to)
                total = (int(twice[a:b].sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 + n) & (2 ** 64 - 1)
                node = int(share * 127) << 56 | total >> 8
                nodes.append(node)
                keys.append(key)
                if n >= WIDE_FROM:
                    wide[i] = _signatures(twice[a:b], np.array([0, n]), WIDE_BITS)[0]
                of.append(np.full(len(key), i))
            m = len(sets)
            text = batch.slice(at, m)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), text.column(0), text.column(1),
                 pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), none,
                 *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(4)), pa.array(wide, longs)],
                names=names)
            if keys:
                of = np.concatenate(of)
                m = len(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int32)), pa.nulls(m, text.column(0).type),
                     pa.nulls(m, pa.int64()), pa.array(nodes, pa.int64()).take(pa.array(of)),
                     pa.array(np.array(sizes, np.int32)[of]),
                     pa.array(np.concatenate(keys).view(np.int64)), *[pa.nulls(m, pa.int64())] * 4,
                     pa.nulls(m, longs)], names=names)
    return run


def _token_sets(size: int):
    def run(batches):
        for batch, at, sets in _each_set(batches, 1, size):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(sets)),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["node", "tokens"])
    return run


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` (written, narrow rows) for a join: broadcast if it is small, by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, hashed: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold, by their exact overlap (written).  The
    text of one document of each class in the pairs is read again."""
    pairs = _possible_wide(pairs, classes, percent)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(classes.join(nodes, "node", "left_semi").select("node", "text_hash", "key_id"))
    sets = materialize(
        hashed.withColumn("key_id", F.coalesce("id", F.lit(0)))
        .join(_bounded(wanted), ["text_hash", "key_id"]).select("node", "text")
        .mapInArrow(_token_sets(size), "node long, tokens array<long>"))
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    right = right.join(pairs.select("b").distinct(), "b", "left_semi")
    both = pairs.join(left, "a").join(right, "b").withColumn(
        "common", F.size(F.array_intersect("ta", "tb")).cast("long"))
    union = F.size("ta") + F.size("tb") - F.col("common")
    found = materialize(both.where(F.col("common") * 100 >= union * percent).select("a", "b").distinct())
    drop_tables(pairs, wanted, sets)
    return found


def _size_fits(n, m, percent: int):
    return (F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent)


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                    percent: int = 90, pairs_up_to: int = PAIRS_UP_TO, counters: int = COUNTERS,
                    frequent: int = FREQUENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row: sets of ``size``-word
    shingles link at a Jaccard similarity of ``percent`` / 100 or more."""
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent must be in 1..100 and size positive")
    spark = small_batches(docs).sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shipped = spark.sparkContext.broadcast(frequent_flags(src.select("text"), size, counters, frequent))
    hashed = src.select("id", F.xxhash64("text").alias("text_hash"), "text")
    rows = materialize(hashed.mapInArrow(
        _index(size, percent, pairs_up_to, counters, shipped),
        "kind int, id long, text_hash long, node long, n int, key long, "
        "w0 long, w1 long, w2 long, w3 long, wide array<long>"))
    documents = materialize(rows.where("kind = 0"))
    index = rows.where("kind = 1").select("key", "node", "n")
    hubs = materialize(index.groupBy("key").agg(
        F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last"))
        .where("hub.node != last").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")))
    met = materialize(index.join(hubs, "key"))
    drop_tables(rows, hubs)
    shared = materialize(met.distinct())
    drop_tables(met)
    classes = materialize(documents.where("node is not null").groupBy("node").agg(
        F.min(F.struct("text_hash", F.coalesce("id", F.lit(0)).alias("key_id"), "n", *_SIGN)).alias("at"),
        F.any_value("wide").alias("wide")).select("node", "at.*", "wide"))
    stars = shared.where((F.col("node") != F.col("hub")) & _size_fits(F.col("n"), F.col("hub_n"), percent))
    signs = classes.select("node", "n", *_SIGN)
    known = _possible(
        stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), signs, percent)
    links = _verified(known, hashed, classes, size, percent)
    roots = materialize(components(links))
    # A few of the pairs first: they join most of what is to be joined.  A pair that
    # has come together is not looked at again, nor is a key all of whose members have.
    member = shared
    for share in FIRST_PAIRS:
        apart = _apart(member, roots)
        drop_tables(member)
        member = apart
        pairs = _cross_pairs(member, signs, share, percent)
        found = _verified(pairs, hashed, classes, size, percent)
        if not found.isEmpty():
            links = links.unionByName(found)
            drop_tables(roots)
            roots = materialize(components(links))
    drop_tables(member, classes)
    return _labelled(documents, roots, id_col)


def _possible(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures leave room for a link."""
    a, b = (signs.select(*[F.col(c).alias(c + side) for c in ("node", "n", *_SIGN)]) for side in "ab")
    both = pairs.join(a, F.col("a") == F.col("nodea")).join(b, F.col("b") == F.col("nodeb"))
    return both.where(_may_link(percent)).select("a", "b")


def _possible_wide(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the wide signatures of large sets do not rule out (written)."""
    a, b = (classes.select(*[F.col(c).alias(c + side) for c in ("node", "n", "wide")]) for side in "ab")
    both = pairs.join(a, F.col("a") == F.col("nodea")).join(b, F.col("b") == F.col("nodeb"))
    total = (F.col("na") + F.col("nb")).cast("long")
    differ = F.aggregate(F.zip_with("widea", "wideb", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda acc, x: acc + x)
    room = (total - differ) * (100 + percent) >= 2 * percent * total
    return materialize(both.where(F.coalesce(room, F.lit(True))).select("a", "b"))


def _may_link(percent: int):
    """Upper bound of the overlap: what the signatures differ in, the sets do not share."""
    differ = sum((F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in _SIGN), F.lit(0))
    total = (F.col("na") + F.col("nb")).cast("long")
    return (_size_fits(F.col("na"), F.col("nb"), percent)
            & ((total - differ) * (100 + percent) >= 2 * percent * total))


def _apart(member: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the keys whose members are in different components (written)."""
    placed = materialize(member.select("key", "node").join(roots, "node", "left")
                         .select("key", "node", F.coalesce("root", "node").alias("root")))
    split = materialize(placed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
                        .where("r1 != r2").select("key"))
    out = materialize(placed.join(split, "key", "left_semi"))
    drop_tables(placed, split)
    return out


def _cross_pairs(member: DataFrame, signs: DataFrame, share: int, percent: int) -> DataFrame:
    """Pairs of a key's members that may link and are in different components so
    far; one in ``share`` by a hash of the pair."""
    member = member.join(signs, "node")
    a, b = (member.select("key", *[F.col(c).alias(c + side) for c in ("node", "n", "root", *_SIGN)])
            for side in "ab")
    meet = (F.col("nodea") > F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & _may_link(percent)
    if share > 1:
        meet &= F.pmod(F.xxhash64("nodea", "nodeb"), F.lit(share)) == 0
    return (a.join(b, (a["key"] == b["key"]) & meet)
            .select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct())


def _labelled(documents: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    placed = materialize(
        documents.select("id", "n", "node").join(roots, "node", "left")
        .select("id", "n", F.coalesce("root", "node").alias("root")))
    least = materialize(placed.where("root is not null").groupBy("root").agg(F.min("id").alias("least")))
    drop_tables(documents, roots)
    return placed.join(least, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
