"""SentencePiece encoding and decoding with a streaming Viterbi search.

Boundaries of a text are reached from left to right by pieces; each boundary keeps the piece
that ends there, which points back to the one before it.  Only the boundaries of the last
``longest piece`` characters can still be extended.  Whenever the paths back from all of these
meet in one boundary, everything up to it is decided: its ids are given out and what was kept of it
is forgotten, so the window does not grow with the text.

Some boundaries are on every path whatever the text, so the search commits there without
walking back: no piece holds a space behind another character, so all paths meet before a space
that follows one; and a line feed, if no piece holds it, is given out as its byte.  The ids of
a stretch between two such boundaries depend on nothing else.  All stretches go through
``_stream``; those it has searched before are remembered, in bounded numbers.

What makes a path survive depends on the model:

* unigram: the largest sum of scores (ties: the longer last piece);
* BPE: a piece may follow another if merging their joint text gives just these two; for each
  boundary exactly one path does so at every step, and it is the one that merging the whole
  text would give.

The ids of BPE models are those of the library.  Scores of the runs of white space in BPE models are all equal
and lowest, which merges them last and from the left; they are handled so.

Two differences from the library, both for exact decoding: U+2581 in a text is encoded as
its bytes, as it would otherwise come back as a space; nothing is normalised, and models
that ask for a normalisation are refused.

Defined results: a null text has null ids and decodes to null; an empty text has no ids;
equal texts have equal ids and repeated rows stay; texts of any length are encoded whole; the
added columns replace others of their names, all other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

SPACE = "▁"
STRETCH = re.compile("( +)([^ ]*)")
#: Words whose ids a worker remembers (twice as many at most), and pairs of pieces it has judged.
MEMO = 120_000
PAIRS = 300_000


class Pieces:
    """A model read from its file: BPE or unigram, with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        settings = _settings(model.serialized_model_proto())
        if settings["normaliser"] != "identity" or settings["extra_spaces"] or not settings["dummy_prefix"] or not settings["escape"]:
            raise ValueError("only models without normalisation, with a leading space")
        self.bpe = settings["type"] == 2
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.names[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        usable = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.names[i]: model.get_score(i) for i in usable}
        self.id = {self.names[i]: i for i in usable}
        if len(self.bytes) != 256:
            raise ValueError("only models with byte fallback")
        if any(SPACE in n.lstrip(SPACE) for n in self.id):
            raise ValueError("only models whose pieces hold no inner space")
        #: Runs of spaces are merged apart from everything else.
        self.runs = {len(n) for n in self.id if len(n) > 1 and not n.strip(SPACE)}
        for n in self.runs if self.bpe else ():
            del self.score[SPACE * n]
        self.unknown = min(self.score.values()) - 10.0  # of a character that is no piece, as the library has it
        self.longest = max(map(len, self.score))
        self.endings = set() if self.bpe else {n[k:] for n in self.score for k in range(len(n))}
        self.barrier = "\n" if not any("\n" in n for n in self.id) else None
        self.space = struct.pack("<i", self.id[SPACE])
        self._barrier = struct.pack("<i", self.bytes[ord(self.barrier)]) if self.barrier else b""
        self._words: dict[str, bytes] = {}  # ids with the space before them
        self._bare: dict[str, bytes] = {}  # those in which the space stays alone
        self._lines: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}  # what was remembered before they were last full
        self._follow: dict[str, dict[str, bool]] = {}  # piece -> piece -> whether the one may come next
        self._pairs = 0
        #: Characters that went through the search, and the most it kept at a time.
        self.searched = self.widest = 0
        self._first = dict.fromkeys(self.score, True)
        self._packed = {n: struct.pack("<i", i) for n, i in self.id.items()}
        self._raw = [self._piece_bytes(i) for i in ids]

    def _piece_bytes(self, i: int) -> bytes:
        if i in self.special:
            return b""
        name = self.names[i]
        return bytes([int(name[1:-1], 16)]) if self.bytes.get(int(name[1:-1], 16) if name.startswith("<0x") else -1) == i else name.replace(SPACE, " ").encode()

    # -- encoding

    def _merge(self, text: str) -> list[str]:
        """Merging by score, the leftmost first among equals; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, left: str, right: str) -> bool:
        known = self._follow.setdefault(left, {})
        ok = known.get(right)
        if ok is None:
            ok = self._merge(left + right) == [left, right]
            if self._pairs < PAIRS:
                known[right] = ok
                self._pairs += 1
        return ok

    def _judge(self, before: str, piece: str) -> bool:
        """Whether the piece, or single character, may come after the one before; remembered."""
        if piece not in self.score and len(piece) > 1:
            ok = False
        elif not before:
            ok = True
        else:
            return self._may_follow(before, piece)
        if before:
            if self._pairs < PAIRS:
                self._follow.setdefault(before, {})[piece] = ok
                self._pairs += 1
        elif len(self._first) < PAIRS:
            self._first[piece] = ok
        return ok

    def _spelled(self, piece: str) -> bytes:
        """The bytes of a character that is no piece."""
        return b"".join([struct.pack("<i", self.bytes[b]) for b in piece.encode()])

    def _stream(self, text: str) -> bytes:
        """Ids of a stretch.  Of the boundaries from ``done`` on, ``pieces`` has the piece that ends there,
        and ``after`` what is known to be able to follow it (BPE) or the sum of scores up to it."""
        bpe, packed, longest, known, endings = self.bpe, self._packed, self.longest, self.score, self.endings
        pieces: list[str] = [""]
        after: list = [self._first if bpe else 0.0]
        done, check, out = 0, 4 * longest, []
        self.searched += len(text)
        for end in range(1, len(text) + 1):
            at = end - 1 - done
            piece = text[end - 1]
            if bpe:
                while True:
                    ok = after[at].get(piece)
                    if ok or (ok is None and self._judge(pieces[at], piece)):
                        break
                    at -= 1  # merging reaches every boundary, so some piece fits
                    piece = text[done + at : end]
                pieces.append(piece)
                follow = self._follow.get(piece)
                if follow is None:
                    follow = self._follow[piece] = {}
                after.append(follow)
            else:
                best, score = piece, after[at] + known.get(piece, self.unknown)
                while at and piece in endings and len(piece) < longest:
                    at -= 1
                    piece = text[done + at : end]
                    if piece in known and after[at] + known[piece] >= score:
                        best, score = piece, after[at] + known[piece]
                pieces.append(best)
                after.append(score)
            if end - done >= check:
                meet = self._meet(pieces)
                if meet:
                    self.widest = max(self.widest, end - done)
                    self._give(pieces, meet, out)
                    pieces, after, done = pieces[meet:], after[meet:], done + meet
                    check = 4 * longest
                else:
                    check = 2 * (end - done)
        self.widest = max(self.widest, len(pieces) - 1)
        self._give(pieces, len(pieces) - 1, out)
        return b"".join(out)

    def _meet(self, pieces: list[str]) -> int:
        """The last boundary that is on the paths to all of the last ``longest`` boundaries."""
        alive = set(range(max(0, len(pieces) - self.longest), len(pieces)))
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(last - len(pieces[last]))
        return alive.pop()

    def _give(self, pieces: list[str], end: int, out: list[bytes]) -> None:
        """Add the ids of the path to a boundary."""
        path = []
        while end:
            piece = pieces[end]
            path.append(self._packed.get(piece) or self._spelled(piece))
            end -= len(piece)
        out.extend(reversed(path))

    def _word(self, word: str) -> bytes:
        """Ids of a space and the word behind it."""
        ids = self._bare.get(word) or self._old.get(word)
        if ids is None:
            if self.barrier and self.barrier in word:
                first, *lines = word.split(self.barrier)
                out = [(self._words.get(first) or self._word(first)) if first else self.space]
                for line in lines:
                    out += (self._barrier, self._begin(line))
                return b"".join(out)
            ids = self._line(word, SPACE)
        if len(word) <= 64:
            if len(self._words) + len(self._bare) >= MEMO:
                self._old, self._words, self._bare = self._words | self._bare, {}, {}
            (self._bare if ids.startswith(self.space) else self._words)[word] = ids
        return ids

    def _begin(self, line: str) -> bytes:
        """Ids of the first word of a line, which has no space before it."""
        ids = self._lines.get(line)
        if ids is None:
            ids = self._line(line, "")
            if len(line) <= 64:
                if len(self._lines) >= MEMO // 4:
                    self._lines.clear()
                self._lines[line] = ids
        return ids

    def _line(self, text: str, before: str) -> bytes:
        """Ids of a stretch; each U+2581 of the text itself is three bytes."""
        if SPACE not in text:
            return self._stream(before + text)
        first, *rest = text.split(SPACE)
        return self._spelled(SPACE).join([self._stream(before + first), *map(self._stream, rest)])

    def _unigram_stretch(self, found: re.Match) -> bytes:
        """Ids of some spaces and what follows up to the next."""
        text = found[0]
        ids = self._words.get(text) or self._old.get(text)
        if ids is None:
            ids = self._line(found[2], SPACE * len(found[1]))
            if len(text) <= 64:
                if len(self._words) >= MEMO:
                    self._old, self._words = self._words, {}
                self._words[text] = ids
        return ids

    @functools.lru_cache(256)  # noqa: B019 (models live as long as their worker)
    def _run(self, n: int) -> bytes:
        """Ids of n spaces: from the left, always the longest run the vocabulary has."""
        out = b""
        for k in sorted({1, *self.runs}, reverse=True):
            out += struct.pack("<i", self.id[SPACE * k]) * (n // k)
            n %= k
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if not self.bpe:
            return b"".join([self._unigram_stretch(m) for m in STRETCH.finditer(" " + text)])
        out: list[bytes] = []
        run, space, bare = 0, self.space, self._bare
        for word in text.split(" "):
            ids = self._words.get(word)
            if ids is None:
                if not word:
                    run += 1
                    continue
                ids = bare.get(word) or self._word(word)
                bare = self._bare
                if ids.startswith(space):  # nothing took the space before the word
                    run += 1
                    ids = ids[4:]
            if run:
                out.append(self._run(run))
                run = 0
            out.append(ids)
        if run:
            out.append(self._run(run))
        return b"".join(out)

    def decode(self, ids: Iterator[int]) -> str:
        return b"".join([self._raw[i] for i in ids]).decode()[1:]


def _settings(proto: bytes) -> dict:
    """What the model file says of its kind and of normalisation (protobuf, fields by number)."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, data[at : at + size]
                at += size

    out = {"type": 1, "normaliser": "", "dummy_prefix": 1, "extra_spaces": 1, "escape": 1}
    for number, value in fields(proto):
        if number == 2:
            out |= {"type": v for n, v in fields(value) if n == 3}
        elif number == 3:
            names = {1: "normaliser", 3: "dummy_prefix", 4: "extra_spaces", 5: "escape"}
            out |= {names[n]: v.decode() if n == 1 else v for n, v in fields(value) if n in names}
    return out


_MODELS: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One model a worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of the text (array of int).  ``model``: path on every machine.

    ``decoded`` names a column for the text that the ids decode to, made by the same workers, so
    that the model is held once."""
    made = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            rest = batch.select([f.name for f in kept])
            first, size, held = 0, 0, []
            for i, x in enumerate(values):
                raw = x.as_py()
                held.append(None if raw is None else pieces.encode(raw))
                size += len(held[-1] or b"")
                if size >= 1 << 22 or i + 1 == len(values):
                    out = _append(rest.slice(first, i + 1 - first), ids, _lists(held))
                    yield _append(out, decoded, pa.array([None if h is None else pieces.decode(memoryview(h).cast("i").tolist()) for h in held], pa.string())) if decoded else out
                    first, size, held = i + 1, 0, []

    return map_arrow(docs, work, T.StructType([*kept, *made]))


def _lists(rows: list[bytes | None]) -> pa.Array:
    offsets, at = [], 0
    for r in rows:
        offsets.append(None if r is None else at)
        at += len(r or b"") // 4
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(r or b"" for r in rows))])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def decode_ids(table: DataFrame, model: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``table`` with the text of the ids."""
    kept = [f for f in table.schema.fields if f.name != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids))
            out = [None if x.as_py() is None else pieces.decode(x.values.to_numpy().tolist()) for x in values]
            yield _append(batch.select([f.name for f in kept]), text, pa.array(out, pa.string()))

    return map_arrow(table, work, T.StructType([*kept, T.StructField(text, T.StringType())]))
