"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Every node carries a failure link and the number of pieces that are complete when the link
is followed, so one walk over a word's symbols counts the pieces of greedy longest-match splitting without building
them and without going back: each symbol either descends or adds popped pieces.

A vocabulary entry is a byte string, or a byte string that must end a word; the end of a word is a symbol of its own.
A word that cannot be split counts as one unknown piece.

Defined results: a null or empty text has 0 pieces; words of any length take time in proportion to their length;
repeated rows are counted one by one; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workers import map_arrow

END = 256
CACHE_WORDS = 300_000


def byte_symbols() -> dict[str, int]:
    """The public byte alphabet: printable Latin-1 characters stand for themselves, the rest for 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Symbol strings of a public tokenizer file's vocabulary; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    special = {t["content"] for t in known.get("added_tokens", [])}
    alphabet, out = byte_symbols(), []
    for piece in known["model"]["vocab"]:
        if piece in special:
            continue
        body = piece.removesuffix(end_mark)
        if not body or any(c not in alphabet for c in body):
            continue
        out.append((*(alphabet[c] for c in body), *((END,) if body != piece else ())))
    return out


class Automaton:
    """Trie with failure links; ``popped[v]`` pieces are complete when the link of node v is followed."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.down: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                after = self.down[node].get(symbol)
                if after is None:
                    after = self.down[node][symbol] = len(self.down)
                    self.down.append({})
                    whole.append(False)
                node = after
            whole[node] = True
        self.link: list[int | None] = [None] * len(self.down)
        self.popped = [0] * len(self.down)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in self.down[node].items():
                queue.append(child)
                if whole[child]:
                    self.link[child], self.popped[child] = 0, 1
                    continue
                back, popped = self.link[node], self.popped[node]
                while back is not None and symbol not in self.down[back]:
                    popped += self.popped[back]
                    back = self.link[back]
                if back is not None:
                    self.link[child], self.popped[child] = self.down[back][symbol], popped

    def count(self, word: bytes) -> int:
        """Pieces of one word, 1 if it cannot be split."""
        down, link, popped = self.down, self.link, self.popped
        node, pieces = 0, 0
        for symbol in (*word, END):
            after = down[node].get(symbol)
            while after is None:
                pieces += popped[node]
                back = link[node]
                if back is None:
                    # only the end of the word may be left without a piece of its own
                    return pieces if symbol == END and node == 0 else 1
                node = back
                after = down[node].get(symbol)
            node = after
        while node:
            pieces += popped[node]
            node = link[node]
            if node is None:
                return 1
        return pieces


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    return Automaton(vocabulary(path))


class Counts(dict):
    """Counts of words seen so far, at most ``CACHE_WORDS`` of them."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(load(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_tokens of the lower-cased text; ``path`` names the tokenizer file on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts(path)
        for batch in batches:
            words = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in words], type=pa.int64()),
                    pa.array([sum(map(known.__getitem__, w)) for w in words], type=pa.int64()),
                ],
                names=[id_col, "n_words", "n_tokens"],
            )

    given = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"))
    kind = given.schema[0].dataType.simpleString()
    return map_arrow(given, run, f"`{id_col}` {kind}, n_words long, n_tokens long")
