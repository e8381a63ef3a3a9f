"""Quality rules as a short-circuit cascade.

Every rule looks at one text and either rejects it or lets it pass; a text is kept when no rule rejects it. On a
sample each rule's time per text and share of rejected texts are measured; the cascade then asks the rules with the
most rejections per second first, and stops at the first rejection. The order changes the time, never the verdict.

Defined results: a null text counts as empty, has no words and is rejected by ``few_words``; repeated rows are
judged one by one; an empty table gives an empty result; columns of the input other than the id and the text are
not looked at, so their names cannot clash.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workers import map_arrow

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# The published thresholds for web text (symbol ratio, mean word length, share of words with a letter,
# share of repeated lines), and a limit on capitals.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 14
MIN_ALPHA_PERCENT = 80
MAX_DUP_LINE_PERCENT = 30
MAX_CAPITAL_PERCENT = 50

_UPPER = bytes(range(65, 91))
_NO_LETTER = re.compile(rb"(?<![^\x20\x09-\x0D])[^A-Za-z\x80-\xff\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Text:
    """One text; each figure is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at exactly the six separators

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS[1:-1]))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, end = Counter(windows), 0, 0
        for start, window in enumerate(windows):
            if counts[window] > 1:
                covered += start + WINDOW - max(start, end)
                end = start + WINDOW
        return covered

    @cached_property
    def n_plain_words(self) -> int:
        """Words without any letter; bytes from 0x80 count as letters."""
        return len(_NO_LETTER.findall(self.raw))

    def count(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def few_words(t: Text) -> bool:
    return t.n_words < MIN_WORDS


def repeated_words(t: Text) -> bool:
    return 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words


def many_symbols(t: Text) -> bool:
    return 100 * t.n_symbols > MAX_SYMBOL_PERCENT * t.n_words


def odd_word_length(t: Text) -> bool:
    return not MIN_MEAN_WORD * t.n_words <= t.word_chars <= MAX_MEAN_WORD * t.n_words


def few_alpha_words(t: Text) -> bool:
    return 100 * (t.n_words - t.n_plain_words) < MIN_ALPHA_PERCENT * t.n_words


def repeated_lines(t: Text) -> bool:
    return 100 * t.n_dup_lines > MAX_DUP_LINE_PERCENT * len(t.lines)


def capitals(t: Text) -> bool:
    return 100 * t.count(_UPPER) > MAX_CAPITAL_PERCENT * t.count(_UPPER + _UPPER.lower())


BASE_RULES = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
RULES = (
    *BASE_RULES,
    Rule("many_symbols", many_symbols),
    Rule("odd_word_length", odd_word_length),
    Rule("few_alpha_words", few_alpha_words),
    Rule("repeated_lines", repeated_lines),
    Rule("capitals", capitals),
)


@dataclass(frozen=True)
class Estimate:
    """What a sample says of one rule."""

    name: str
    rows: int
    rejected: int
    seconds: float

    @property
    def worth(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.seconds, 1e-9)


def estimate(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 17
) -> list[Estimate]:
    """Time and rejections of each rule on a random sample of about ``sample_rows`` texts, measured in the tasks.

    Only one row of sums per rule comes to the driver.
    """
    total = docs.count()
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, rejected, seconds = 0, [0] * len(rules), [0.0] * len(rules)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                rows += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(Text(value))
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"name": names, "rows": [rows] * len(rules), "rejected": rejected, "seconds": seconds})

    sample = docs.select(F.col(text).cast("string").alias("text"))
    if total > sample_rows:
        sample = sample.sample(fraction=sample_rows / total, seed=seed)
    sums = map_arrow(sample, measure, "name string, rows long, rejected long, seconds double").groupBy("name").agg(
        F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")
    )
    found = {r.name: Estimate(r.name, r.rows, r.rejected, r.seconds) for r in sums.collect()}
    return [found.get(n) or Estimate(n, 0, 0, 0.0) for n in names]


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """Most rejections per second first; a tie keeps the given order."""
    worth = {e.name: e.worth for e in estimates}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def judge(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the base figures, ``base_failed``, ``kept``, and the rule at which the cascade stopped with its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                t = Text(value)
                base_failed = any(r.rejects(t) for r in BASE_RULES)
                stop, asked = None, 0
                for asked, rule in enumerate(rules, 1):
                    if rule.rejects(t):
                        stop = rule.name
                        break
                out.append(
                    (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base_failed, stop is None and not base_failed, stop, asked)
                )
            columns = list(zip(*out)) if out else [[] for _ in range(9)]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds))],
                names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "n_asked"],
            )

    given = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"))
    kind = given.schema[0].dataType.simpleString()
    return map_arrow(
        given, run, f"`{id_col}` {kind}, {FEATURES}, base_failed boolean, kept boolean, rejected_by string, n_asked int"
    )


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Estimate, order, judge."""
    return judge(docs, ordered(rules, estimate(docs, rules, text, sample_rows)), id_col, text)
