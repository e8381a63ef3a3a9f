"""Encoding and decoding with merge-type sentencepiece vocabularies, by a score-ordered agenda of symbol pairs.

A normalised text starts as one symbol a character. Every adjacent pair whose concatenation is a piece of the vocabulary
stands in an agenda ordered by score, the leftmost first among equals; the best pair is joined, its new neighbours enter
the agenda, and pairs that no longer exist are passed over. Pieces marked unused are taken apart again by the joins that
made them. What is no piece becomes its UTF-8 bytes, or the unknown id where the vocabulary has no bytes.

Two characters that stand side by side in no piece can never be joined, so a text is cut between such characters and
each part is merged on its own. Parts repeat, as words do: each worker keeps the results of short parts in a bounded
store, so that the agenda runs once for most words. Long parts are merged every time.

Normalisation (the vocabulary's own rules) is left to the library. ``digest`` checks the agenda against the library in
every Arrow batch: each part that the worker does not know yet is encoded by both, behind a character that joins nothing,
and a row says whether all its parts agreed. As no piece crosses a cut, texts agree when their parts do; ``disagreeing``
compares whole texts. Vocabularies without bytes, or whose normalisation would change a part, are checked by whole texts.

Defined results: a null text is empty and has no ids; a very long text is one value of one row, held by the task that
reads it; rows are independent, so repeated rows get equal results; an empty table gives an empty result; other columns
are carried along by ``encode`` and ``decode``, whose own column has a name of the caller's choice, and not read by
``digest``. Vocabularies with symbols defined by their user, or not of the merge type, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.workers import map_arrow

SPACE = "▁"
KEPT_PARTS = 3 << 17
SHORT = 48
GROUP_CHARS = 1 << 19

# Fixed values of the model file: kinds of pieces, and the merge type of the trainer.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message; nested messages and texts are bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """A vocabulary: encodes texts to ids and ids to texts."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
        if trainer.get(3) != MERGES:
            raise ValueError("the vocabulary is not of the merge type")
        if USER_DEFINED in self.kinds:
            raise ValueError("the vocabulary has symbols defined by its user")
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        ids = range(len(self.names))
        self.joined = {self.names[i]: i for i in ids if self.kinds[i] in (NORMAL, UNUSED)}
        self.reserved = {self.names[i]: i for i in ids if self.kinds[i] in (UNKNOWN, CONTROL, BYTE)}
        self.unknown = next(i for i in ids if self.kinds[i] == UNKNOWN)
        self.byte_ids = [self.reserved[f"<0x{b:02X}>"] for b in range(256)] if trainer.get(35) else None
        self.bytes = {i: b for b, i in enumerate(self.byte_ids or [])}
        self.joints = {p[k : k + 2] for p in self.joined for k in range(len(p) - 1)}
        # whether two characters stand side by side in some piece, by the numbers of both
        self.number = np.zeros(0x110000, dtype=np.int32)
        met = sorted({c for j in self.joints for c in j})
        self.number[[ord(c) for c in met]] = np.arange(1, len(met) + 1)
        self.meet = np.zeros((len(met) + 1, len(met) + 1), dtype=bool)
        for a, b in self.joints:
            self.meet[self.number[ord(a)], self.number[ord(b)]] = True
        # the agenda takes the least rank first
        self.rank = {name: -self.scores[i] for name, i in self.joined.items()}
        self.unused = {name for name, i in self.joined.items() if self.kinds[i] == UNUSED}
        # what the worker knows of short parts: (number of ids, ids as text, decoded text, whether the library agrees)
        self.store: dict[str, tuple[int, str, str, bool]] = {}
        self.lone = next(chr(c) for c in (10, 1, *range(0xE000, 0xF8FF)) if not self.number[c])
        self.lead = self.library.encode(self.lone)
        kept = self.library.normalize(f"{self.lone}  a ").endswith(f"{self.lone}{SPACE}{SPACE}a{SPACE}")
        self.by_parts = bool(self.byte_ids) and kept

    def merge(self, part: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece."""
        made: dict[str, tuple[str, str]] = {}
        out = self._merge_short(list(part), made) if len(part) <= SHORT else self._merge_long(list(part), made)
        while made and any(s in made for s in out):
            out = [t for s in out for t in made.get(s, (s,))]
        return out

    def _merge_short(self, symbols: list[str], made: dict[str, tuple[str, str]]) -> list[str]:
        """The agenda has a place for each adjacent pair, in their order; few places are searched faster than kept sorted."""
        rank, unused, never = self.rank.get, self.unused, math.inf
        agenda = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)  # the leftmost of equals
            right = symbols.pop(i + 1)
            piece = symbols[i] + right
            if unused and piece in unused:
                made[piece] = (symbols[i], right)
            symbols[i] = piece
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(piece + symbols[i + 1], never)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + piece, never)
        return symbols

    def _merge_long(self, symbols: list[str], made: dict[str, tuple[str, str]]) -> list[str]:
        """The agenda is a heap; a joined symbol stays at its first character's place."""
        last = len(symbols) - 1
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        rank, unused = self.rank.get, self.unused
        agenda: list[tuple[float, int, int, int]] = []

        def add(left: int, right: int) -> None:
            piece = symbols[left] + symbols[right]
            found = rank(piece)
            if found is not None:
                heapq.heappush(agenda, (found, left, right, len(piece)))

        for i in range(last):
            add(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            piece = symbols[left] + symbols[right]
            if piece in unused:
                made[piece] = (symbols[left], symbols[right])
            symbols[left], symbols[right] = piece, ""
            after[left] = after[right]
            if after[right] <= last:
                before[after[right]] = left
                add(left, after[right])
            if before[left] >= 0:
                add(before[left], left)
        return [s for s in symbols if s]

    def parts(self, normal: str) -> list[str]:
        """Parts of a normalised text that no join crosses."""
        if not normal:
            return []
        code = self.number[np.frombuffer(normal.encode("utf-32-le"), dtype=np.uint32)]
        cuts = (np.flatnonzero(~self.meet[code[:-1], code[1:]]) + 1).tolist()
        return [normal[a:b] for a, b in zip([0, *cuts], [*cuts, len(normal)])]

    def ids(self, part: str) -> list[int]:
        """The ids of one part."""
        out: list[int] = []
        for symbol in self.merge(part):
            found = self.reserved.get(symbol, self.joined.get(symbol))
            if found is not None and found != self.unknown:
                out.append(found)
            elif self.byte_ids:
                out += (self.byte_ids[b] for b in symbol.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(self.library.normalize(text)):
            ids = self.ids(part)
            # a run of unknown symbols is one id
            out += ids[1:] if out and ids[0] == self.unknown == out[-1] else ids
        return out

    def _described(self, parts: list[str]) -> list[tuple[int, str, str, bool]]:
        """What the worker is to know of each part."""
        own = [self.ids(p) for p in parts]
        theirs = self.library.encode([self.lone + p.replace(SPACE, " ") for p in parts], num_threads=1)
        lead = len(self.lead)
        return [
            (len(ids), ",".join(map(str, ids)), self.surface(ids), ids == other[lead:] and self.lead == other[:lead])
            for ids, other in zip(own, theirs)
        ]

    def described(self, texts: list[str]) -> list[tuple[int, str, str, bool]]:
        """(number of ids, ids as decimal text, decoded text, whether the library agrees) of each text."""
        if not self.by_parts:
            own = [self.encode(t) for t in texts]
            return [(len(i), ",".join(map(str, i)), self.decode(i), self.agrees(t, i)) for t, i in zip(texts, own)]
        cut = [self.parts(self.library.normalize(t)) for t in texts]
        if len(self.store) > KEPT_PARTS:
            self.store.clear()
        store = self.store
        new = list({p for parts in cut for p in parts if p not in store})
        here = dict(zip(new, self._described(new)))
        store.update((p, known) for p, known in here.items() if len(p) <= SHORT)
        out = []
        for parts in cut:
            if not parts:
                out.append((0, "", "", True))
                continue
            counts, ids, surfaces, agree = zip(*[store.get(p) or here[p] for p in parts])
            text, first = "".join(surfaces), ids[0].partition(",")[0]
            # the space that every text is given at its start
            lead = self.names[int(first)].startswith(SPACE)
            out.append((sum(counts), ",".join(ids), text[1:] if lead else text, all(agree)))
        return out

    def agrees(self, text: str, ids: list[int]) -> bool:
        """Whether the library gives a whole text these ids, and these ids the same text."""
        return self.library.encode(text, num_threads=1) == ids and self.library.decode(ids) == self.decode(ids)

    def surface(self, ids) -> str:
        """The text of a run of ids inside a text. Bytes that form no character become replacement characters."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(characters(run))
                run.clear()
            kind = self.kinds[i]
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            elif kind != CONTROL:
                out.append(self.names[i].replace(SPACE, " "))
        if run:
            out.append(characters(run))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of ids; the space that every text is given at its start goes again."""
        ids = list(ids)
        start = 0
        while start < len(ids) and self.kinds[ids[start]] == CONTROL:
            start += 1
        text = self.surface(ids[start:])
        piece = self.names[ids[start]] if start < len(ids) and self.kinds[ids[start]] in (NORMAL, UNUSED) else ""
        return text[1:] if piece.startswith(SPACE) else text


def characters(run: bytearray) -> str:
    """UTF-8 with one replacement character for every byte that belongs to no character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        return run.decode(errors="bytewise")


def _bytewise(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


@lru_cache(maxsize=4)
def _loaded(model: bytes) -> Pieces:
    import codecs

    codecs.register_error("bytewise", _bytewise)
    return Pieces(model)


def load(path: str) -> bytes:
    """The model file's bytes, which go to the workers; its place need not exist there."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The rows with the ids of their text; an existing column named ``into`` is replaced."""
    if into == text:
        raise ValueError("the ids need a column of their own")
    model = load(path)
    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            ids = pa.array([pieces.encode(t or "") for t in texts], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, into])

    return map_arrow(kept, run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids are empty, ids that the vocabulary does not have an error."""
    model = load(path)
    kept = rows.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([pieces.decode(x or []) for x in lists], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, into])

    return map_arrow(kept, run, schema)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts with about ``GROUP_CHARS`` characters; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and whether the library agreed with the agenda on every part."""
    model = load(path)
    given = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model)
        for batch in batches:
            first = 0
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                found = pieces.described(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(group)),
                        pa.array([f[0] for f in found], type=pa.int64()),
                        *(pa.array([hashlib.sha256(f[i].encode()).hexdigest() for f in found], type=pa.string()) for i in (1, 2)),
                        pa.array([f[3] for f in found], type=pa.bool_()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"],
                )
                first += len(group)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean"
    return map_arrow(given, run, schema)


def disagreeing(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows whose whole text the library encodes, or whose ids it decodes, otherwise."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.filter(pa.array([not pieces.agrees(t, pieces.encode(t)) for t in texts], type=pa.bool_()))

    return map_arrow(docs, run, docs.schema)
