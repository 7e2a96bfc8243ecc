"""Operator 8: personal data by patterns, and by bootstrapped contexts.

Seeds.  E-mail addresses, IPv4 addresses, card numbers (13 to 19 digits, Luhn)
and phone numbers (9 to 15 digits) are found by regular expressions, leftmost
and not overlapping within a kind; matches that fail their check are dropped.

Bootstrapping.  Instances are seeds, whole (seeds that overlap are one, of the
first one's kind), and beside them runs of white-space-separated tokens that hold a
digit, joined by blanks (a token that ends in punctuation ends its run), and tokens
with an at sign; punctuation at their end is no part of them.  The words before an instance
(the last one, the last two), an assignment that it follows or begins with
(``key=``, ``key:``) and, if it has brackets or hyphens, its form (digits as 9,
letters as a) are its contexts, ASCII letters in lower case.  Instances and
contexts make a bipartite graph.  Seed instances
start with confidence 1 for their kind; a context's confidence for a kind is the
mean confidence of its distinct instances, zero below ``SUPPORT`` distinct
instances that hold the kind already; an instance's confidence is the largest of its
contexts'.  After ``ROUNDS`` rounds, instances that no seed overlaps and that meet
``CONFIDENCE`` become spans of that kind (of the kind with the highest confidence,
ties by the order of kinds).  Generic contexts reach unlike tokens and lose
confidence; specific ones reveal identifiers the patterns cannot match.

DataFrame functions only.  Positions are code points, ends exclusive.  Only texts
with a digit or an at sign are looked at; a text's matches and instances stay in its
row's arrays (bounded by the text); the graph's edges are shuffled, aggregated
map-side, its nodes are never collected.

Null text is empty; rows come back one for one, repeated ones too (they count
once in the graph, which holds distinct instances); null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurescape.session import materialize

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5                  # distinct known instances of a kind that a context needs
CONFIDENCE = 0.8
ROUNDS = 3

# The patterns of the four kinds.  A match starts where its first run of
# characters starts, or where the match before it ended (\G); possessive runs
# keep long texts linear and match the same strings, as nothing that follows
# such a run can begin with one of its characters.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Instances are read from a text whose seeds are overwritten, by two marks in turn
# (code points that are no characters).
_MARKS, _NO_MARKS = "\ufdd0\ufdd1", "\ufdd2\ufdd2"
_NUMBER = rf"[^\s0-9@{_MARKS}]*+[0-9][^\s@{_MARKS}]*+(?!\S)"
_INSTANCE = (rf"{_MARKS[0]}++|{_MARKS[1]}++|(?<!\S){_NUMBER}(?:(?<![.,;:!?])[\x20\t]++{_NUMBER})*+"
             rf"|(?<!\S)[^\s@{_MARKS}]*+@[^\s{_MARKS}]*+(?!\S)")
_LAST_PART = r"(?<!\S)(\S++)$"
_STOP = r"(?<![.,;:!?])[.,;:!?]++$"
_ASSIGNED = r"^([A-Za-z_-]++[=:])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<start:int,end:int,raw:string>>"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _spans(found: Column, gaps: Column) -> Column:
    """(start, end, raw) of matches in order, from the texts of the matches and
    of the gaps before them."""
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.greatest(F.size(found), F.lit(0))), found,
                       lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("n"), m.alias("raw")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(pairs, zero, lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["n"]).alias("end"),
            p["raw"].alias("raw")))).alias("out")), lambda acc: acc["out"])


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _luhn(raw: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    back = F.reverse(_digits(raw))
    n = F.char_length(back)

    def term(i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _octets(raw: Column) -> Column:
    def small(part):
        short = F.regexp_replace(part, "^0+", "")
        return (F.char_length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(raw, r"\."), small)


_CHECKS = {
    "email": lambda raw: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda raw: F.char_length(_digits(raw)).between(9, 15),
}


def _disjoint(spans: Column) -> Column:
    """Spans in order; of overlapping ones the first, the longest of equal
    starts, which takes in what sticks out of it."""
    spans = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(
        F.when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(F.lit(0))))
    zero = F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))                # null at first
        joined = F.struct(last["kind"].alias("kind"), last["start"].alias("start"),
                          F.greatest(last["end"], s["end"]).alias("end"))
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s["start"] < last["end"], F.concat(before, F.array(joined))).otherwise(
            F.concat(acc, F.array(s)))

    return F.aggregate(spans, zero, step)


def _replaced(text: Column, spans: str, by) -> Column:
    """``text`` with the i-th of its disjoint spans replaced by ``by(i)``."""
    n = F.size(spans)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(
        F.substr(text, F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1)["end"] + 1),
                 F.when(i == n, F.char_length(text)).otherwise(F.get(spans, i)["start"])
                 - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])),
        F.when(i == n, F.lit("")).otherwise(by(i))))
    return F.concat_ws("", pieces)


def _found(rows: DataFrame, name: str, column: str, pattern: str, may: str) -> DataFrame:
    """Matches of a pattern (f_name) and the gaps before them (g_name)."""
    none = F.array().cast("array<string>")
    ok = F.col("some") & F.col(column).rlike(may)
    rows = rows.withColumn(f"f_{name}", F.when(ok, F.regexp_extract_all(
        column, F.lit(f"({pattern})"), F.lit(1))).otherwise(none))
    return rows.withColumn(f"g_{name}", F.when(F.size(f"f_{name}") > 0, F.split(column, pattern, -1)).otherwise(none))


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, one array of checked spans a kind, instances): one row for
    each row; the text itself goes no further."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("some", F.col("text").rlike("[0-9@]"))
    for k in KINDS:
        rows = _found(rows, k, "text", _PATTERNS[k], _MAY[k])
    checked = []
    for k in KINDS:
        check = _CHECKS[k]
        spans = _spans(F.col(f"f_{k}"), F.col(f"g_{k}"))
        checked.append(F.filter(spans, lambda s: check(s["raw"])).alias(k))  # noqa: B023 (used at once)
    rows = rows.select("id", "text", "some", *checked)
    rows = rows.withColumn("seeds", _disjoint(F.concat(*[_of_kind(k) for k in KINDS])))
    marked = _replaced(F.translate("text", _MARKS, _NO_MARKS), "seeds", lambda i: F.repeat(
        F.when(i % 2 == 0, F.lit(_MARKS[0])).otherwise(F.lit(_MARKS[1])),
        F.get("seeds", i)["end"] - F.get("seeds", i)["start"]))
    rows = rows.withColumn("marked", F.when(F.size("seeds") > 0, marked).otherwise(
        F.translate("text", _MARKS, _NO_MARKS)))
    rows = _found(rows, "token", "marked", _INSTANCE, f"[0-9@{_MARKS}]")

    # What stands between two instances, less the rest of the first one's token,
    # ends in the words before the second and what leads its token.
    def before(gap, i):
        gap = F.when(i > 0, F.regexp_replace(gap, r"^\S++", "")).otherwise(gap)
        words = F.filter(F.split(_lower(F.regexp_replace(gap, _LAST_PART, "")), r"\s+"), lambda w: w != "")
        return F.struct(F.concat_ws(" ", F.slice(words, -2, 2)).alias("words"),
                        F.regexp_extract(gap, _LAST_PART, 1).alias("lead"))

    contexts = F.transform(F.slice("g_token", F.lit(1), F.greatest(F.size("f_token"), F.lit(0))), before)
    every = F.zip_with(_spans(F.col("f_token"), F.col("g_token")), contexts, lambda s, c: F.struct(
        s["start"].alias("start"), s["raw"].alias("raw"), c["words"].alias("words"), c["lead"].alias("lead")))
    rows = rows.withColumn("every", every)

    def instance(x, raw, kind):
        return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(raw)).alias("end"), raw.alias("raw"),
                        x["words"].alias("words"), x["lead"].alias("lead"), kind.alias("kind"))

    def seed(x):
        return F.substr(x["raw"], F.lit(1), F.lit(1)).isin(*_MARKS)

    # Each seed is one run of a mark, in the seeds' order.
    seeds = F.zip_with(F.filter("every", seed), F.col("seeds"), lambda x, s: instance(
        x, F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]), s["kind"]))
    loose = F.transform(F.filter("every", lambda x: ~seed(x)), lambda x: instance(
        x, F.regexp_replace(x["raw"], _STOP, ""), F.lit(None).cast("string")))
    return rows.select("id", F.xxhash64("text").alias("text_hash"), *KINDS, F.concat(seeds, loose).alias("instances"))


def _graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances without a seed by row, and the distinct edges
    (instance, context, kind of the seed or null)."""
    one = (found.where(F.size("instances") > 0)
           .select("id", "text_hash", F.explode("instances").alias("i"))
           .select("id", "text_hash", "i.start", "i.end", F.col("i.raw").alias("instance"),
                   "i.words", "i.lead", "i.kind"))
    assigned = _lower(F.regexp_extract(F.concat("lead", "instance"), _ASSIGNED, 1))
    last = F.regexp_extract("words", r"(\S++)$", 1)
    # The form of an instance with a bracket or hyphen: digits as 9, letters as a.
    bare = F.regexp_replace("instance", _ASSIGNED, "")
    form = F.when(bare.rlike(r"[()-]"), F.concat(F.lit("form "), F.regexp_replace(
        F.regexp_replace(bare, r"\p{L}++", "a"), "[0-9]", "9"))).otherwise("")
    contexts = F.array_distinct(F.filter(F.array(F.col("words"), last, assigned, form), lambda c: c != ""))
    edges = one.select("instance", "kind", F.explode(contexts).alias("context")).distinct()
    return one.where("kind is null").select("id", "text_hash", "start", "end", "instance"), edges


def _discover(edges: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(instance, kind) of unseeded instances that the graph is sure of."""
    edges = materialize(edges)
    # An instance that is a seed somewhere counts as that seed everywhere.
    seeds = materialize(edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
                        .withColumn("score", F.lit(1.0)))
    links = materialize(edges.select("instance", "context").distinct())
    sizes = materialize(links.groupBy("context").agg(F.count("*").alias("size")).where(F.col("size") >= support))
    known, found = seeds, None
    for _ in range(rounds):
        held = links.join(known, "instance").groupBy("context", "kind").agg(
            F.sum("score").alias("sum"), F.sum((F.col("score") >= confidence).cast("int")).alias("sure"))
        scored = held.where(F.col("sure") >= support).join(sizes, "context").select(
            "context", "kind", (F.col("sum") / F.col("size")).alias("score"))
        order = F.struct(F.col("score"), *[(F.col("kind") == k).cast("int") for k in KINDS], F.col("kind"))
        found = (links.join(scored, "context").join(seeds.select("instance"), "instance", "left_anti")
                 .groupBy("instance").agg(F.max(order).alias("best"))
                 .select("instance", F.col("best.kind").alias("kind"), F.col("best.score").alias("score")))
        found = materialize(found)
        known = seeds.unionByName(found)
    return found.where(F.col("score") >= confidence).select("instance", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT,
         confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(id, text_hash, one array of base spans a kind, found): ``found`` holds the
    added spans (kind, start, end, raw)."""
    rows = materialize(_matches(docs, id_col, text_col))
    loose, edges = _graph(rows)
    sure = _discover(edges, support, confidence, rounds)
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    added = materialize(
        loose.join(sure, "instance").withColumn("key", key)
        .groupBy("key", "text_hash").agg(F.collect_set(F.struct(    # bounded by a text's instances
            "kind", "start", "end", F.col("instance").alias("raw"))).alias("found")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,raw:string>>")
    return (rows.withColumn("key", key).join(added, ["key", "text_hash"], "left")
            .select(F.col("id").alias(id_col), "text_hash", *KINDS, F.coalesce("found", none).alias("found")))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _of_kind(k: str) -> Column:
    return F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _with_found(k: str) -> Column:
    more = F.transform(F.filter("found", lambda s: s["kind"] == k), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(F.concat(_of_kind(k), more))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of ``find``'s rows."""
    base = F.concat(*[_of_kind(k) for k in KINDS])
    every = F.concat(*[_with_found(k) for k in KINDS])
    return found.select(
        id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"),
        F.size("found").cast("long").alias("n_found"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in angle brackets
    (``_disjoint`` ones).  Null texts stay null."""
    small = (found.withColumn("spans", _disjoint(F.concat(*[_with_found(k) for k in KINDS]))).where(F.size("spans") > 0)
             .select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
                     F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).dropDuplicates(["_key", "_hash"]))
    small = materialize(small)
    text = F.col(text_col)
    rows = docs.withColumn("_key", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn(
        "_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    marks = _replaced(text, "_spans", lambda i: F.concat(F.lit("<"), F.upper(F.get("_spans", i)["kind"]), F.lit(">")))
    new = F.when(F.col("_spans").isNull(), text).otherwise(marks)
    return rows.join(small, ["_key", "_hash"], "left").withColumn(text_col, new).select(docs.columns)
