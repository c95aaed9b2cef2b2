"""Quality rules as a short-circuit cascade.

A rule rejects a text by a statistic of it. On a sample every rule is timed and its
rejections are counted; the cascade then asks the rules by rejections per second, and
the first rejection ends it. A text is kept if no rule rejects it, so the order changes
what it costs and never what is kept. The sample is about ``SAMPLE_ROWS`` rows, drawn by
a hash of their values; it only sets the order.

Statistics are computed once per text and only if a rule or the caller asks for them.

Defined results: a null text is empty and has zero of everything; without a word no
ratio rule rejects; repeated rows get equal rows; an empty table keeps the rules' own
order. Columns other than doc_id and text are ignored.
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

from presage.llm.common import BLANKS, small_batches

SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: Runs of scripts that set no space between words: Thai, Lao, Tibetan, Burmese, Khmer, Tai, Chinese, Japanese, Yi.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u312f\u3190-\ua4cf"
                      "\uf900-\ufaff\ufe30-\ufe4f\uff00-\uff9f\U00020000-\U0003ffff]+")
#: So many of their characters count as a word.
UNSPACED_WORD = 2
BEYOND_ASCII = re.compile("[^\x00-\x7f]+")


class Stats:
    """Statistics of one text, each computed when first read."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()

    def _count(self, chars: bytes) -> int:
        return len(self.data) - len(self.data.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self._count(BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return self._count(SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return self._count(UPPER)

    @cached_property
    def n_lower(self) -> int:
        return self._count(LOWER)

    @cached_property
    def is_ascii(self) -> bool:
        return len(self.text) == len(self.data)

    @cached_property
    def n_unspaced(self) -> int:
        return 0 if self.is_ascii else sum(map(len, UNSPACED.findall(self.text)))

    @cached_property
    def n_units(self) -> int:
        """Words, those of scripts without spaces by their characters."""
        return self.n_words + self.n_unspaced // UNSPACED_WORD

    @cached_property
    def n_cases(self) -> tuple[int, int]:
        """Upper and lower letters of every script that has them."""
        rest = "" if self.is_ascii else "".join(BEYOND_ASCII.findall(self.text))
        return self.n_upper + sum(map(str.isupper, rest)), self.n_lower + sum(map(str.islower, rest))

    @cached_property
    def n_marks(self) -> int:
        return self._count(b"!?")

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for line in self.data.split(b"\n") if line.strip(BLANKS))

    @cached_property
    def n_dup_lines(self) -> int:
        seen, n = set(), 0
        for line in self.data.split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip(BLANKS):
                seen.add(line)
        return n

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that are found twice or more."""
        w = self.words
        windows = len(w) - 2
        if windows < 2 or len(set(zip(w, w[1:], w[2:]))) == windows:
            return 0
        times = Counter(zip(w, w[1:], w[2:]))
        n = reached = 0
        for i, window in enumerate(zip(w, w[1:], w[2:])):
            if times[window] > 1:
                n += i + 3 - max(i, reached)
                reached = i + 3
        return n


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], bool]


def too_short(words: int) -> Rule:
    return Rule("too_short", lambda s: s.n_words < words)


def repeated(percent: int, least_words: int = 0) -> Rule:
    return Rule("repeated", lambda s: s.n_words >= least_words and 100 * s.n_repeat_words > percent * s.n_words)


def symbols(percent: int) -> Rule:
    return Rule("symbols", lambda s: 100 * s.n_symbols > percent * s.n_words)


def marks(percent: int) -> Rule:
    return Rule("marks", lambda s: 100 * s.n_marks > percent * s.n_words)


def shouting(percent: int) -> Rule:
    return Rule("shouting", lambda s: 100 * s.n_upper > percent * (s.n_upper + s.n_lower))


def word_length(low: float, high: float) -> Rule:
    return Rule("word_length", lambda s: s.n_words > 0 and not low <= s.word_chars / s.n_words <= high)


def dup_lines(percent: int) -> Rule:
    return Rule("dup_lines", lambda s: 100 * s.n_dup_lines > percent * s.n_lines)


def symbols_any(percent: int) -> Rule:
    return Rule("symbols", lambda s: 100 * s.n_symbols > percent * s.n_units)


def marks_any(percent: int) -> Rule:
    return Rule("marks", lambda s: 100 * s.n_marks > percent * s.n_units)


def shouting_any(percent: int, least_words: int) -> Rule:
    """Upper case by the letters of every script, in texts of ``least_words`` or more whose letters mostly have a case."""

    def rejects(s: Stats) -> bool:
        if s.n_units < least_words:
            return False
        upper, lower = s.n_cases
        return 100 * upper > percent * (upper + lower) and 2 * (upper + lower) >= s.word_chars

    return Rule("shouting", rejects)


def word_length_any(low: float, high: float) -> Rule:
    """Characters of scripts without spaces make no word long; where most are such, none is too short either."""

    def rejects(s: Stats) -> bool:
        if not s.n_words:
            return False
        return s.word_chars - s.n_unspaced > high * s.n_words or (
            s.word_chars < low * s.n_words and 2 * s.n_unspaced <= s.word_chars)

    return Rule("word_length", rejects)


#: The base rules of the reports: n_words < 50, more than half of the words in repeated windows.
BASE = (too_short(50), repeated(50))
#: What marks machine text and junk in languages of Latin letters; prose stays far below each limit. The SQL of
#: op4_quality_cascade fixes these.
JUNK = (symbols(20), marks(30), shouting(60), word_length(2.0, 25.0), dup_lines(50))
#: The same limits for texts of any script, and of a few words.
JUNK_ANY = (symbols_any(20), marks_any(30), shouting_any(60, 10), word_length_any(2.0, 25.0), dup_lines(50))


def measure(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[str, float, float]]:
    """(rule, seconds per text, share rejected) on the sample."""
    small_batches(docs.sparkSession)
    rows = docs.count()
    share = min(1.0, 1.5 * sample_rows / max(rows, 1))
    drawn = docs.select("text").where(
        F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    ) if share < 1 else docs.select("text")

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for i, rule in enumerate(rules):
                    stats = Stats(text)  # a rule is timed alone, with the statistics that it needs
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(stats)
                    seconds[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "n": [n] * len(rules), "seconds": seconds, "rejected": rejected},
                                         pa.schema([("rule", pa.int32()), ("n", pa.int64()), ("seconds", pa.float64()), ("rejected", pa.int64())]))

    found = drawn.mapInArrow(timed, "rule int, n long, seconds double, rejected long").groupBy("rule").agg(
        F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    by = {r["rule"]: r for r in found.collect()}  # a row for each rule
    return [(rule.name, by[i]["seconds"] / max(by[i]["n"], 1), by[i]["rejected"] / max(by[i]["n"], 1)) if i in by else (rule.name, 0.0, 0.0)
            for i, rule in enumerate(rules)]


def order(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """By rejections per second of work, the most first; equal ones stay in their order."""
    worth = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in measured}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def cascade(docs: DataFrame, rules: tuple[Rule, ...], report: tuple[str, ...] = (), flags: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
    """doc_id, the statistics named in ``report``, a boolean for each of ``flags`` (one of its rules rejects),
    rejected_by (the first rule of the given order that rejects, else null) and kept."""
    small_batches(docs.sparkSession)
    flags = flags or {}
    schema = "doc_id long, " + "".join(f"{c} long, " for c in report) + "".join(f"{c} boolean, " for c in flags) + "rejected_by string, kept boolean"
    types = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in report), *((c, pa.bool_()) for c in flags), ("rejected_by", pa.string()), ("kept", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                s = Stats(text)
                by = next((r.name for r in rules if r.rejects(s)), None)
                out.append((*(getattr(s, c) for c in report), *(any(r.rejects(s) for r in of) for of in flags.values()), by, by is None))
            columns = [pa.array(x, f.type) for x, f in zip(zip(*out), list(types)[1:])] if out else [pa.array([], f.type) for f in list(types)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, schema)


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects, in the measured order of rules."""
    small_batches(docs.sparkSession)
    ordered, at = order(rules, measure(docs, rules)), docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = map(Stats, batch.column(at).to_pylist())
            yield batch.filter(pa.array([not any(r.rejects(s) for r in ordered) for s in stats], pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)
