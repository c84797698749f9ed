"""SentencePiece encoding and decoding as the shortest path through a weighted finite-state transducer.

Three machines are compiled from the model, and an input is composed with them one after another:

* The normaliser is a sequential transducer over a trie of the strings that the model's character map replaces. On a
  character without an arc it writes what the longest replaced prefix stands for and follows a failure arc to the state
  of the rest; a machine of three states then strips and collapses spaces, where the model says so, and writes marks.
* The piece machine is an automaton over the pieces with an arc into its start state at the end of each piece, which
  writes the piece's id. A unigram model weighs it by the negative score. In a merge (BPE) model the state remembers the
  last piece, and the arc of a piece weighs 0 or infinity: a piece may follow another if merging the two side by side
  leaves them as they are. A sequence of pieces is what merging gives precisely when each piece and each neighbouring
  pair is, so exactly one path is finite.
* The byte machine has an arc for each character that no piece is, which writes its byte pieces (or the unknown piece).

Weights are in the tropical semiring (min, +); the encoding is the shortest path through the composition. No piece holds
a space mark after another character, so paths can be cut before each run of marks (checked when the model is compiled);
such segments repeat, and their paths are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import ship, texts_of
from quadloom.llm.sp_model import BYTE, NORMAL, SPACE, UNKNOWN, UNUSED, USER_DEFINED, ModelSpec, parse_model

INF = float("inf")
#: State before the first piece and after a character of the byte machine: any piece may follow.
FREE = -1


def replacements(charsmap: bytes) -> dict[str, str]:
    """The strings that a precompiled character map replaces: a double-array trie of UTF-8 keys, then the replacements."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64), charsmap[4 + size :]
    # Fixed values of the format: bits of a unit.
    base = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 0x200) >> 6))
    found: dict[str, str] = {}
    at, keys = np.zeros(1, np.int64), [b""]
    while len(at):
        below = base(at)[:, None] ^ np.arange(1, 256)
        inside = below < len(units)
        parent, label = np.nonzero(inside & ((units[np.where(inside, below, 0)] & 0x800000FF) == np.arange(1, 256)))
        at, keys = below[parent, label], [keys[p] + bytes([c + 1]) for p, c in zip(parent.tolist(), label.tolist(), strict=True)]
        for leaf, place in zip(np.flatnonzero((units[at] >> 8) & 1).tolist(), (units[base(at[(units[at] >> 8) & 1 == 1])] & 0x7FFFFFFF).tolist(), strict=True):
            found[keys[leaf].decode()] = texts[place : texts.index(b"\0", place)].decode()
    return found


class Replacer:
    """Sequential transducer that replaces the leftmost longest strings: `arcs` by character, `fail` and what it writes."""

    def __init__(self, rules: dict[str, str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.fail, self.writes, spelled = [0], [""], [""]
        for key in sorted(rules, key=len):
            at = 0
            for c in key:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = len(self.arcs)
                    self.arcs.append({})
                    spelled.append(spelled[at] + c)
                at = self.arcs[at][c]
        self.fail, self.writes = [0] * len(spelled), [""] * len(spelled)
        for at in sorted(range(1, len(spelled)), key=lambda k: len(spelled[k])):
            s = spelled[at]
            n = next((n for n in range(len(s), 0, -1) if s[:n] in rules), 0)
            out, rest = [rules[s[:n]]] if n else [s[0]], 0
            for c in s[max(n, 1) :]:
                rest = self._step(rest, c, out)
            self.fail[at], self.writes[at] = rest, "".join(out)
        self.starts = re.compile("[" + "".join(map(re.escape, self.arcs[0])) + "]") if rules else None

    def _step(self, state: int, char: str, out: list[str]) -> int:
        while char not in self.arcs[state]:
            if not state:
                out.append(char)
                return 0
            out.append(self.writes[state])
            state = self.fail[state]
        return self.arcs[state][char]

    def __call__(self, text: str) -> str:
        if self.starts is None:
            return text
        out: list[str] = []
        state = at = 0
        while at < len(text):
            if not state:  # characters that begin no replaced string are copied
                found = self.starts.search(text, at)
                begin = found.start() if found else len(text)
                out.append(text[at:begin])
                at = begin
                if found is None:
                    break
            state = self._step(state, text[at], out)
            at += 1
        while state:
            out.append(self.writes[state])
            state = self.fail[state]
        return "".join(out)


class _Paths(dict):
    """word -> ids of the segment that is a mark and the word; filled on demand, emptied when it holds `most` of them.

    Each path is decoded when it is made. Decoding a text is decoding its segments one after another, so a text comes back
    whole exactly if all its segments do; `lossy` holds those that don't.
    """

    def __init__(self, machine: PieceTransducer, most: int):
        super().__init__()
        self.machine, self.most, self.lossy = machine, most, set()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        machine, segment = self.machine, SPACE + word
        ids = tuple(machine.path(segment))
        if "".join(map(machine.spec.pieces.__getitem__, ids)) != segment and machine.decode(ids) != word:
            self.lossy.add(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class PieceTransducer:
    def __init__(self, model: bytes | ModelSpec, most_segments: int = 500_000):
        spec = self.spec = model if isinstance(model, ModelSpec) else parse_model(model)
        if spec.has_user_pieces:
            raise ValueError("models with user-defined pieces aren't compiled")
        self.replace = Replacer(replacements(spec.charsmap))
        self.ids = {p: i for i, (p, t) in enumerate(zip(spec.pieces, spec.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(spec.pieces, spec.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(spec.types) if t == UNKNOWN), 0)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.whole_words = self.cuts and spec.is_identity and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        self.table = _Paths(self, most_segments)
        self.unknown_cost = 0.0 if spec.is_bpe else 10.0 - min((spec.scores[i] for i in self.ids.values()), default=0.0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        # Merges go by falling score, the leftmost of equals first; single characters are there before all merges.
        rank = {score: k for k, score in enumerate(sorted({spec.scores[k] for k in self.ids.values()}, reverse=True))}
        self.order = {k: rank[spec.scores[k]] if len(p) > 1 else -1 for p, k in self.ids.items()}
        self.machine = ahocorasick.Automaton()
        for p in sorted(self.ids, key=len):
            if len(p) == 1 or not spec.is_bpe or self._made_of(p):
                self.machine.add_word(p, (self.ids[p], len(p)))
        self.machine.make_automaton()
        self.text_of = [self._decoded(i) for i in range(len(spec.pieces))]

    # --- normaliser ---------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        """Output of the normaliser: the text over the alphabet of pieces."""
        spec = self.spec
        out = self.replace(text)
        if spec.remove_extra_whitespaces:
            out = " ".join(x for x in out.split(" ") if x)
        if spec.add_dummy_prefix and (out or text and not spec.remove_extra_whitespaces):
            out = " " + out
        return out.replace(" ", SPACE) if spec.escape_whitespaces else out

    def segments(self, text: str) -> Iterator[str]:
        """The normalised text cut before each run of space marks."""
        if not self.cuts:
            if text:
                yield text
            return
        run, first = 0, True
        for part in text.split(SPACE):
            if not first:
                run += 1
            first = False
            if part:
                yield SPACE * run + part
                run = 0
        if run:
            yield SPACE * run

    # --- encoding -----------------------------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text."""
        words = text.split(" ") if text else []
        if self.whole_words and "" not in words and SPACE not in text:
            paths = map(self.table.__getitem__, words)  # one mark before each word: the usual case
        else:
            paths = map(self.path, self.segments(self.normalise(text)))
        return np.fromiter(chain.from_iterable(paths), np.int32)

    def arcs(self, s: str) -> Iterator[tuple[int, int, int]]:
        """The composition of a normalised string with the pieces and bytes: (begin, end, piece) by rising end.

        Where no piece is the single character before `end`, there is an arc of the byte machine, with FREE as its piece.
        """
        done, single = 0, True
        for last, (piece, length) in self.machine.iter(s):
            end = last + 1
            if end > done:
                if not single:
                    yield done - 1, done, FREE
                for between in range(done + 1, end):
                    yield between - 1, between, FREE
                done, single = end, False
            single = single or length == 1
            yield end - length, end, piece
        if not single:
            yield done - 1, done, FREE
        for between in range(done + 1, len(s) + 1):
            yield between - 1, between, FREE

    def path(self, s: str) -> list[int]:
        """Ids along the shortest path of a normalised string."""
        backs, lasts = self._relaxed_merges(s) if self.spec.is_bpe else self._relaxed_scores(s)
        out: list[int] = []
        n = len(s)
        while n:
            begin, piece = backs[n], lasts[n]
            if piece >= 0:
                out.append(piece)
            else:
                out += self._emit(s[begin:n])[::-1]
            n = begin
        out.reverse()
        if not self.spec.is_bpe and not self.spec.byte_fallback:  # neighbouring unknown characters are one unknown
            out = [k for i, k in enumerate(out) if k != self.unknown or not i or out[i - 1] != k]
        return out

    def _relaxed_scores(self, s: str) -> tuple[list[int], list[int]]:
        """Per position the begin and the piece of the best arc into it: arcs are relaxed in the order of their ends."""
        n, scores = len(s), self.spec.scores
        costs, backs, lasts = [0.0] + [INF] * n, [0] * (n + 1), [FREE] * (n + 1)
        for begin, end, piece in self.arcs(s):
            cost = costs[begin] + (self.unknown_cost if piece == FREE else -scores[piece])
            if cost < costs[end]:
                costs[end], backs[end], lasts[end] = cost, begin, piece
        return backs, lasts

    def _relaxed_merges(self, s: str) -> tuple[list[int], list[int]]:
        """The same for weights 0 and infinity, where a state is a position and the last piece.

        One state of a position is finite, for a string's beginning has one encoding. That is the byte machine's, whose
        arc weighs 1, until an arc of a piece, which weighs 0, is finite; then the others into that position aren't.
        """
        n, pairs = len(s), self.pairs
        backs, lasts = list(range(-1, n)), [FREE] * (n + 1)
        for last, (piece, length) in self.machine.iter(s):
            end = last + 1
            if lasts[end] >= 0:
                continue
            before = lasts[end - length]
            if before >= 0:
                fits = pairs.get((before, piece))
                if not (self._may_follow(before, piece) if fits is None else fits):
                    continue
            backs[end], lasts[end] = end - length, piece
        return backs, lasts

    def _emit(self, char: str) -> list[int]:
        """Output of the byte machine for a character that no piece has."""
        if self.spec.byte_fallback and self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "replace")]
        return [self.unknown]

    def _made_of(self, piece: str) -> bool:
        """Compiles the last merge that makes a piece: the one cut whose two sides would stay apart if the piece weren't there."""
        k, ids, order = self.ids[piece], self.ids, self.order
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is None or b is None or any(order[x] >= 0 and x not in self.parts for x in (a, b)):
                continue
            if self._apart(a, b, made=k):
                if max(order[a], order[b]) > order[k]:
                    raise ValueError("the scores of the model aren't those of merges in their order")
                self.parts[k] = a, b
                return True
        return False

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the arc of piece b after piece a has weight 0; kept in a table of bounded size."""
        if len(self.pairs) >= 2_000_000:
            self.pairs.clear()
        fits = self.pairs[a, b] = self._apart(a, b)
        return fits

    def _apart(self, a: int, b: int, made: int = -1) -> bool:
        """Whether merging the texts of a and b side by side gives the two again (but for a merge into `made`).

        The merges that made a and b are undone, latest first; if at any point the pieces that touch could merge before
        the merge that was just undone, the two would not have come about. A piece on the right gives way to a merge of
        the same rank, for the leftmost of equals goes first.
        """
        pieces, order, parts = self.spec.pieces, self.order, self.parts
        limit = 1 << 60
        while True:
            both = self.ids.get(pieces[a] + pieces[b])
            if both is not None and both != made and order[both] < limit:
                return False
            if order[a] < 0 and order[b] < 0:
                return True
            if order[a] > order[b]:
                limit = order[a]
                a = parts[a][1]
            else:
                limit = order[b] + 1
                b = parts[b][0]

    # --- decoding -----------------------------------------------------------------------------------------------

    def _decoded(self, i: int) -> bytes:
        kind, piece = self.spec.types[i], self.spec.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED, UNUSED) else " ⁇ ".encode() if kind == UNKNOWN else b""

    def decode(self, ids) -> str:
        """The inverse machine: pieces and bytes to text, without the leading space that the normaliser added."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.spec.add_dummy_prefix and text.startswith(" ") else text

    def comes_back(self, text: str, ids) -> bool:
        """Whether decoding the ids of the text gives it again."""
        words = text.split(" ") if text else []
        if "" in words or SPACE in text or not self.whole_words:
            return self.decode(ids) == self.round_trip(text)
        return not self.table.lossy or self.table.lossy.isdisjoint(words)

    def round_trip(self, text: str) -> str:
        """What decoding gives if encoding lost nothing: the text with the mark itself read as a space."""
        body = self.normalise(text).replace(SPACE, " ")
        return body[1:] if body and self.spec.add_dummy_prefix else body


_compiled: dict[bytes, PieceTransducer] = {}


def compiled(model: bytes) -> PieceTransducer:
    """The transducer of a model, compiled once in a Python worker; the last one is kept."""
    key = hashlib.sha256(model).digest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = PieceTransducer(model)
    return _compiled[key]


def encode_documents(documents: DataFrame, model_path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip.

    Whole texts, null as empty; an empty text has no tokens. round_trip: decoding the ids gives the text again (false only
    for text that is no valid Unicode). Repeated rows are encoded each. A null id stays null. Other columns are ignored.
    The model file is read by the driver and broadcast (its size doesn't grow with the data).
    """
    ship(documents.sparkSession)
    with open(model_path, "rb") as f:
        model = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                values, ends, shas, same = [], [0], [], []
                for text in texts_of(part.column(1)):
                    ids = machine.encode(text)
                    values.append(ids)
                    ends.append(ends[-1] + len(ids))
                    shas.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                    same.append(machine.comes_back(text, ids))
                flat = np.concatenate(values) if values else np.zeros(0, np.int32)
                columns = [part.column(0), pa.array(np.diff(ends), pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                columns += [pa.array(shas, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "round_trip"]
    schema = "doc_id long, n_tokens long, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, round_trip boolean"
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids -> doc_id and text; null ids give a null text."""
    ship(encoded.sparkSession)
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model.value)
        for batch in batches:
            texts = [None if ids is None else machine.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
