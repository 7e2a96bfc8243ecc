"""Operator 7: byte-level BPE encoding and decoding by a tokenization automaton.

The automaton reads *tokens*.  It starts with one state and an arc per base
symbol.  Each merge ``(u, v) -> w`` applies one gadget, in rank order: the
target of every u-arc loses its v-arc (after u, a v would have been merged),
every state that has a u-arc gets a w-arc, and the w-arc leads to a copy of
the v-state as it was before the gadget.  A state is therefore named by the
token just read, it is deterministic, and a token sequence is accepted exactly
if it is the BPE encoding of its own labels; each string has one such path.

A state's row (the arcs it lost) is what the gadgets leave of the arc set:

* gadget ``k = (x, y)`` takes y from every state copied from x's state after
  step k (x on the right spine of the state's token, merged away later), and
* every token built on a lost arc's left end after that step is lost too (y on
  the left spine of the token, not yet merged away).

All rows together hold about 70 million lost arcs for a 50k vocabulary, so
the table is not written out: the gadgets are compiled into arrays, the spines of all
tokens with the steps that merged their parts away, from which an arc is
decided in a few look-ups.  The arrays are compiled once, in the driver, and workers
get nothing else.  The distinct pre-split words of a few MB of text are
encoded together: byte by byte, of the labels that end there the one is taken that has
an arc from the state where it starts, which there is one of.  Very long words
walk arcs one by one, longest label first, leaving positions known to lead
nowhere.  No word is kept beyond its batch.  Decoding emits the labels of the arcs.

Null text is empty: no tokens, empty decoded text.  Special tokens of the
vocabulary found in a text are one token each.  Rows, repeated or not, come
back one for one; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurescape.llm.common import enter, mix64, runs, slices, small_batches, strings, text_bytes

# The byte-level pre-split pattern of the public vocabulary.
PRE_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
             r"|\s+(?!\S)|\s+")
ARCS_KEPT = 500_000        # arcs of the table a worker keeps
SHORT = (3, 2, 1)           # lengths that every start is tried with, longest first
DECODE_STEP = 1 << 18       # ids decoded at a time
LONG_WORD = 48              # bytes; longer pre-split words are walked one by one
SPECIAL = "\ud800"          # marks a special token among pre-split pieces: in no text
STEP_BYTES = 1 << 20        # text whose distinct words are encoded together
LOOK_UPS = 1 << 16          # look-ups of lost arcs done at a time, one pair's at least
_SPACE_BEFORE_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Merges, ids, labels and special tokens of a tokenizers JSON file.

    The file must describe what this operator implements (byte-level pieces,
    no normalizer, no added prefix space); anything else is refused."""
    with open(path, "rb") as f:
        return parse_vocabulary(f.read())


def parse_vocabulary(data: bytes) -> dict:
    """:func:`load_vocabulary` of a file's bytes."""
    spec = json.loads(data)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer")
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    alphabet = byte_alphabet()
    special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    labels = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items()
              if s not in special}
    ids = {s: i for s, i in model["vocab"].items()}
    merges = []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((ids[a], ids[b], ids[a + b]))
    return {"labels": labels, "merges": merges, "special": special}


def _longer(key: np.ndarray, byte: np.ndarray, place: int) -> np.ndarray:
    """Key of a byte string with one more byte in front, the ``place``-th from its end:
    packed up to seven bytes, mixed beyond."""
    byte = byte.astype(np.uint64) + np.uint64(1)
    if place < 7:
        return key | (byte << np.uint64(9 * place))
    return mix64(key + byte * np.uint64(0x9E3779B97F4A7C15) + np.uint64(place))


class Automaton:
    """Tokenization automaton of one vocabulary (see the module's docstring)."""

    def __init__(self, vocabulary: dict):
        self.label = dict(vocabulary["labels"])
        self.special = dict(vocabulary["special"])
        self.arc = {b: i for i, b in self.label.items()}
        self.size = max([*self.label, *self.special.values()], default=0) + 1
        self.made: dict[int, tuple[int, int, int]] = {}        # w -> u, v, step
        self.step_of: dict[int, int] = {}                      # u * size + v -> step
        self.spines: tuple[dict, dict] = ({}, {})
        self.never = len(vocabulary["merges"]) + 1
        for step, (u, v, w) in enumerate(vocabulary["merges"]):
            self.step_of.setdefault(u * self.size + v, step)
            self.made.setdefault(w, (u, v, step))
        for w in sorted(self.made, key=lambda w: self.made[w][2]):
            u, v, _ = self.made[w]
            alive = self.arc.get(self.label[u]) == u and self.arc.get(self.label[v]) == v
            if not (alive and self._arises(w)):
                self.arc.pop(self.label[w], None)              # an arc that is never made
        self.table: dict[int, bool] = {}                       # state * size + token -> lost
        self._compile()
        emitted = dict(self.label) | {i: t.encode() for t, i in self.special.items()}
        self.emit_len = np.array([len(emitted.get(i, b"")) for i in range(self.size)], np.int64)
        self.emit_at = np.cumsum(self.emit_len) - self.emit_len
        self.emit = np.frombuffer(b"".join(emitted.get(i, b"") for i in range(self.size)), np.uint8)
        self.arcs = np.array(sorted(self.arc.values()), np.int32)
        # From here on the arrays say it all; objects would weigh on every worker.
        del self.label, self.arc, self.made, self.step_of, self.spines

    @cached_property
    def arc(self) -> dict[bytes, int]:
        """Tokens by their labels; only very long words ask for it."""
        at, size, emit = self.emit_at[self.arcs].tolist(), self.emit_len[self.arcs].tolist(), self.emit.tobytes()
        return {emit[i:i + n]: t for t, i, n in zip(self.arcs.tolist(), at, size)}

    @cached_property
    def lengths(self) -> dict[bytes, tuple]:
        """Lengths of labels by their first four bytes, longest first."""
        by_start: dict[bytes, set] = {}
        for label in self.arc:
            if len(label) > 3:
                by_start.setdefault(label[:4], set()).add(len(label))
        return {start: (*sorted(found, reverse=True), *SHORT) for start, found in by_start.items()}

    def _compile(self) -> None:
        """The tables that drive encoding: both spines of every token, the steps of all
        merges, and the labels as a trie read from their ends."""
        self.spine_at, self.spine_n, self.spine_token, self.spine_until = [], [], [], []
        for side in (1, 0):
            every = [self._spine(t, side) if t in self.label else [] for t in range(self.size)]
            n = np.array([len(e) for e in every], np.int64)
            self.spine_n.append(n)
            self.spine_at.append(np.cumsum(n) - n)
            self.spine_token.append(np.array([x for e in every for x, _ in e], np.int64))
            self.spine_until.append(np.array([until for e in every for _, until in e], np.int64))
        keys = np.array(sorted(self.step_of), np.int64)
        self.merge_keys = np.append(keys, np.iinfo(np.int64).max)
        self.merge_steps = np.array([*[self.step_of[k] for k in keys.tolist()], self.never], np.int64)
        nodes: dict[bytes, int] = {}
        for label, token in self.arc.items():
            for i in range(len(label)):
                nodes.setdefault(label[i:], -1)
            nodes[label] = token
        ends = sorted(nodes, key=len)
        raw = np.zeros((len(ends), len(ends[-1]) if ends else 0), np.uint8)
        for row, end in zip(raw, ends):
            row[:len(end)] = list(end[::-1])
        size = np.array([len(e) for e in ends], np.int64)
        key = np.zeros(len(ends), np.uint64)
        names = np.zeros(len(ends), np.uint64)
        for i in range(raw.shape[1]):
            key = _longer(key, raw[:, i], i)
            names = np.where(size == i + 1, key, names)
        order = np.argsort(names)
        if len(ends) and (np.diff(names[order]) == 0).any():
            raise ValueError("two labels share a key")         # never seen: up to seven bytes a key is exact
        self.node_keys = np.append(names[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.node_token = np.append(np.array([nodes[e] for e in ends], np.int64)[order], -1)

    def lost_many(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`lost` of many pairs."""
        out = np.zeros(len(before), bool)
        work = np.concatenate([[0], np.cumsum(self.spine_n[0][before] * self.spine_n[1][token])])
        for i, j in slices(work, LOOK_UPS):
            u, t = before[i:j], token[i:j]
            right, left = self.spine_n[0][u], self.spine_n[1][t]
            pair = np.repeat(np.arange(len(u)), right * left)
            k = runs(np.zeros(len(u), np.int64), right * left)
            x = self.spine_at[0][u][pair] + k // left[pair]
            y = self.spine_at[1][t][pair] + k % left[pair]
            key = self.spine_token[0][x] * self.size + self.spine_token[1][y]
            at = np.searchsorted(self.merge_keys, key)
            step = np.where(self.merge_keys[at] == key, self.merge_steps[at], self.never)
            gone = (step < self.spine_until[0][x]) & (step <= self.spine_until[1][y])
            out[i + pair[gone]] = True
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Paths of many words: all tokens, and each word's number of them.

        All words advance byte by byte together.  The state at a byte is the last token of
        the path that spells the word so far; of the labels that end there (the trie tells
        them, shortest first) exactly one has an arc from the state where it starts."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        short = short[np.argsort(-size[short], kind="stable")]
        n = size[short]
        wide = int(n[0]) if len(n) else 0
        raw = np.zeros((len(short), wide), np.uint8)
        raw[np.arange(wide) < n[:, None]] = np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)
        state = np.full((len(short), wide + 1), -1, np.int32)
        back = np.zeros((len(short), wide + 1), np.int32 if wide > 255 else np.uint8)
        for i in range(1, wide + 1):
            row = np.arange(int(np.searchsorted(-n, -i, side="right")))      # words of i bytes or more
            key = np.zeros(len(row), np.uint64)
            rows, tokens, starts = [], [], []
            for j in range(i - 1, -1, -1):
                key = _longer(key, raw[row, j], i - 1 - j)
                at = np.searchsorted(self.node_keys, key)
                hit = self.node_keys[at] == key
                row, key, at = row[hit], key[hit], at[hit]
                if not len(row):
                    break
                ends = np.flatnonzero(self.node_token[at] >= 0)
                rows.append(row[ends])
                tokens.append(self.node_token[at[ends]])
                starts.append(np.full(len(ends), j))
            if not rows:
                raise ValueError("a byte has no token")
            rows, tokens, starts = np.concatenate(rows), np.concatenate(tokens), np.concatenate(starts)
            before = state[rows, starts].astype(np.int64)
            pair, which = np.unique(np.where(starts > 0, before, 0) * self.size + tokens, return_inverse=True)
            free = ~self.lost_many(pair // self.size, pair % self.size)[which]
            good = (starts == 0) | ((before >= 0) & free)
            state[rows[good], i] = tokens[good]
            back[rows[good], i] = starts[good]
        count = np.zeros(len(words), np.int64)
        found, owner, place = [], [], []
        row, at, step = np.arange(len(short)), n.copy(), 0
        while len(row):
            found.append(state[row, at])
            owner.append(row)
            place.append(np.full(len(row), step))
            at = back[row, at].astype(np.int64)
            row, at, step = row[at > 0], at[at > 0], step + 1
        long = {i: self.encode_word(words[i]) for i in np.flatnonzero(size > LONG_WORD).tolist()}
        for i, ids in long.items():
            count[i] = len(ids)
        if found:
            found, owner, place = np.concatenate(found), short[np.concatenate(owner)], np.concatenate(place)
            if (found < 0).any():
                raise ValueError("a word has no path")
            count += np.bincount(owner, minlength=len(words))
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        if len(found):
            out[first[owner] + count[owner] - 1 - place] = found
        for i, ids in long.items():
            out[first[i]:first[i] + count[i]] = ids
        return out, count

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Left (side 0) or right (1) parts of a token, down to its outer byte,
        each with the step that merged it away (none for the token itself)."""
        kept = self.spines[side]
        if token not in kept:
            out, until, x = [], self.never, token
            while True:
                out.append((x, until))
                if x not in self.made:
                    break
                made = self.made[x]
                x, until = made[side], min(until, made[2])
            kept[token] = out
        return kept[token]

    def lost(self, before: int, token: int) -> bool:
        """The state after ``before`` has no arc for ``token``: a gadget took it,
        or took the arc it is built on."""
        return bool(self.lost_many(np.array([before]), np.array([token]))[0])

    def encode_word(self, word: bytes) -> list[int]:
        """Path of the automaton that spells one pre-split word."""
        arc, table, lengths, n = self.arc, self.table, self.lengths, len(word)
        t = arc.get(word)
        if t is not None:                                      # the start state has every arc
            return [t]
        path: list[int] = []
        tried: list[int] = []                                  # of each arc's start: lengths looked at
        dead: set[int] = set()
        at = k = state = 0
        while at < n:
            sizes = lengths.get(word[at:at + 4], SHORT)
            while k < len(sizes):
                end = at + sizes[k]
                k += 1
                if end > n or end in dead:
                    continue
                t = arc.get(word[at:end])
                if t is None:
                    continue
                if at:
                    gone = table.get(state + t)
                    if gone is None:
                        if len(table) >= ARCS_KEPT:
                            table.clear()
                        gone = table[state + t] = self.lost(path[-1], t)
                    if gone:
                        continue
                path.append(t)
                tried.append(k)
                at, state, k = end, t * self.size, 0
                break
            else:                                              # no arc goes on from here
                if not path:
                    raise ValueError(f"no path for {word[:40]!r}")
                dead.add(at)
                at -= int(self.emit_len[path.pop()])
                k = tried.pop()
                state = path[-1] * self.size if path else 0
        return path

    def _arises(self, w: int) -> bool:
        """The gadget of ``w`` found its two arcs in a row: no earlier gadget
        had taken an arc on v's left spine from a state on u's right spine."""
        u, v, now = self.made[w]
        for x, x_until in self._spine(u, 1):
            for y, y_until in self._spine(v, 0):
                step = self.step_of.get(x * self.size + y, now)
                if step < min(now, x_until) and step <= y_until:
                    return False
        return True

    def decode(self, ids: np.ndarray) -> bytes:
        """Labels of the arcs, one after the other."""
        out = []
        for i in range(0, len(ids), DECODE_STEP):
            part = ids[i:i + DECODE_STEP]
            size = self.emit_len[part]
            end = np.cumsum(size)
            at = np.repeat(self.emit_at[part] - end + size, size)
            at += np.arange(len(at))
            out.append(self.emit[at].tobytes())
        return b"".join(out)


class Encoder:
    """Pre-splits whole texts and encodes the pieces, each distinct one of a batch once."""

    def __init__(self, vocabulary: dict):
        self.automaton = Automaton(vocabulary)
        self.pattern = regex.compile(PRE_SPLIT)
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        size = self.automaton.size
        spelled = [f"{i},".encode() for i in range(size)]
        self.spelled_len = np.array([len(t) for t in spelled], np.int64)
        self.spelled = np.array(spelled, dtype=f"S{self.spelled_len.max()}").view(np.uint8).reshape(size, -1)

    def split(self, text: str) -> list[str]:
        """Pre-split pieces of a text; special tokens in it are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        return [w for part in self.special.split(text)
                for w in ([SPECIAL + part] if part in self.automaton.special else self.pattern.findall(part))]

    def _split_parts(self, spaced: list[str], others: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """Pre-split pieces of parts that stand after a space, then of ``others`` (already
        split), and the number of pieces of each.  Parts without white space at their ends
        are split in one go, joined by spaces: no piece spans a space."""
        inner = [i for i, p in enumerate(spaced) if p and p == p.strip()]
        count = np.zeros(len(spaced), np.int64)
        first = np.zeros(len(spaced), np.int64)
        pieces = self.pattern.findall(" " + " ".join([spaced[i] for i in inner])) if inner else []
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        wanted = np.cumsum([len(spaced[i]) + 1 for i in inner], dtype=np.int64)
        cut = np.searchsorted(ends, wanted)
        if len(inner) and (len(ends) <= cut[-1] or (ends[cut] != wanted).any()):
            raise ValueError("a piece spans a space")
        count[inner] = np.diff(cut, prepend=-1)
        first[inner] = cut + 1 - count[inner]
        for i in set(range(len(spaced))).difference(inner):
            held = self.pattern.findall(" " + spaced[i])
            first[i], count[i] = len(pieces), len(held)
            pieces += held
        at = runs(first, count).tolist()
        return [pieces[i] for i in at] + [w for o in others for w in o], np.append(count, [len(o) for o in others]).astype(np.int64)

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_batch(pa.array([text]))[0].tolist()

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's end among them.

        A space behind a character that is not white space begins a new piece, so texts are
        cut there in Arrow and each distinct part is encoded once; texts with white space
        before a space or with special tokens are encoded one by one."""
        raw, offsets = text_bytes(column)
        texts = strings(raw, offsets)
        odd = pc.match_substring_regex(texts, _SPACE_BEFORE_SPACE).to_numpy(zero_copy_only=False).astype(bool)
        for token in self.automaton.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        parts = pc.split_pattern(texts, " ")
        bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        # A text's first part has no space before it.
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
        codes[bounds[:-1] - bounds[0]] += 1
        count = np.diff(bounds)
        codes = codes[np.repeat(~odd, count)]
        of_code = np.zeros(2 * len(words), np.int64)
        used = np.flatnonzero(np.bincount(codes, minlength=len(of_code)))
        alone = np.flatnonzero(odd)
        pieces, n_pieces = self._split_parts(
            [words[c >> 1] for c in used[used % 2 == 0].tolist()],
            [self.pattern.findall(words[c >> 1]) for c in used[used % 2 == 1].tolist()]
            + [self.split(texts[i].as_py()) for i in alone.tolist()])
        used = np.concatenate([used[used % 2 == 0], used[used % 2 == 1]])
        of_code[used] = np.arange(len(used))
        number: dict[str, int] = {}
        piece = np.fromiter((number.setdefault(w, len(number)) for w in pieces), np.int64, len(pieces))
        pool, n_ids = self._distinct(list(number))
        first_id = np.cumsum(n_ids) - n_ids
        # Ids of every part, from those of its pieces.
        pool = pool[runs(first_id[piece], n_ids[piece])]
        ends = np.concatenate([[0], np.cumsum(n_ids[piece])])[np.concatenate([[0], np.cumsum(n_pieces)])]
        first, size = ends[:-1], np.diff(ends)
        # The parts of every text in order: an odd text is one part.
        count = np.where(odd, 1, count)
        order = np.empty(int(count.sum()), np.int64)
        is_odd = np.repeat(odd, count)
        order[is_odd] = len(used) + np.arange(len(alone))
        order[~is_odd] = of_code[codes]
        ids = pool[runs(first[order], size[order])]
        tokens = np.concatenate([[0], np.cumsum(size[order])])
        return ids, tokens[np.cumsum(count)]

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and each one's number of them."""
        special = {i: self.automaton.special[w[len(SPECIAL):]] for i, w in enumerate(words) if w.startswith(SPECIAL)}
        ids, count = self.automaton.encode_words([b"" if i in special else w.encode() for i, w in enumerate(words)])
        if special:
            count[list(special)] = 1
            out = np.zeros(int(count.sum()), np.int64)
            first = np.cumsum(count) - count
            out[first[list(special)]] = list(special.values())
            is_special = np.zeros(len(words), bool)
            is_special[list(special)] = True
            out[~np.repeat(is_special, count)] = ids
            ids = out
        return ids, count

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """SHA-256 of each text's decimal ids joined by commas."""
        flat = self.spelled[ids].reshape(-1)
        view = memoryview(flat[flat != 0].tobytes())
        at = np.concatenate([[0], np.cumsum(self.spelled_len[ids])])[np.concatenate([[0], ends])].tolist()
        return [hashlib.sha256(view[i:max(i, j - 1)]).hexdigest() for i, j in zip(at, at[1:])]


def _encoder(shipped) -> Encoder:
    """The encoder that came with a task; a worker keeps it as long as its broadcast."""
    enter("bpe")
    return shipped.value


def _ship(df: DataFrame, path: str):
    # Bounded by the vocabulary (12 MB for 50k tokens), compiled by the driver alone.
    encoder = Encoder(load_vocabulary(path))       # refused here rather than in a task
    shipped = small_batches(df).sparkSession.sparkContext.broadcast(encoder)
    del encoder
    enter("bpe")                                   # what building it took goes back
    return shipped


def _parts(batches):
    """Batches cut to a few MB of text (column 1)."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets, STEP_BYTES):
            yield batch.slice(i, j - i)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text gives no tokens."""
    shipped = _ship(df, path)

    def run(batches):
        enc = _encoder(shipped)
        for b in _parts(batches):
            ids, ends = enc.encode_batch(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, ends)], names=["id", "ids"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids: the arc labels in order, as UTF-8
    (bytes that are not UTF-8 become U+FFFD); null ids give empty text."""
    shipped = _ship(df, path)

    def run(batches):
        automaton = _encoder(shipped).automaton
        for b in batches:
            texts = [automaton.decode(np.array(i or [], np.int64)).decode("utf-8", "replace")
                     for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())],
                                             names=["id", "text"])

    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded_sha256) of every row: the ids, and the SHA-256
    of the text decoded from them.  Columns named in ``keep`` follow."""
    return _digested(df, path, id_col, text_col, True, keep)


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the comma-joined ids, SHA-256 of the
    text decoded from those ids."""
    return _digested(df, path, id_col, text_col, False)


def _digested(df: DataFrame, path: str, id_col: str, text_col: str, with_ids: bool,
              keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    shipped = _ship(df, path)
    ids_name = "ids" if with_ids else "ids_sha256"

    def run(batches):
        enc = _encoder(shipped)
        for b in _parts(batches):
            ids, ends = enc.encode_batch(b.column(1))
            text_hash = []
            for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
                decoded = enc.automaton.decode(ids[i:j]).decode("utf-8", "replace").encode()
                text_hash.append(hashlib.sha256(decoded).hexdigest())
            held = _lists(ids, ends) if with_ids else pa.array(enc.digests(ids, ends), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ends, prepend=0), pa.int64()), held,
                 pa.array(text_hash, pa.string()), *b.columns[2:]],
                names=["id", "n_tokens", ids_name, "decoded_sha256", *keep])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    kind = src.schema["id"].dataType.simpleString()
    ids_kind = "array<int>" if with_ids else "string"
    more = "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(
        run, f"id {kind}, n_tokens long, {ids_name} {ids_kind}, decoded_sha256 string{more}"
    ).withColumnRenamed("id", id_col)
