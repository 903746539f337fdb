"""Operator 2: quality rules in a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm import texts as T
from concordia.llm.scratch import small_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


class Profile:
    """What rules ask about a text; each figure is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return T.words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that occurs twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        count, total, covered = Counter(windows), 0, 0
        for i, window in enumerate(windows):
            if count[window] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total

    @cached_property
    def n_capitals(self) -> int:
        return len(re.findall("[A-Z]", self.text))

    @cached_property
    def n_small(self) -> int:
        return len(re.findall("[a-z]", self.text))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count("!")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Profile], bool]


#: The base that every verdict rests on.
BASE = (
    Rule("too_short", lambda p: p.n_words < 50),
    Rule("repetitive", lambda p: 100 * p.n_repeat_words > 50 * p.n_words),
)
#: The method's rules.  All thresholds are whole-number ratios.
RULES = (
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("duplicate_lines", lambda p: 10 * p.n_dup_lines > 5 * len(p.lines)),
    Rule("capitals", lambda p: p.n_capitals > p.n_small),
    Rule("shouting", lambda p: 10 * p.n_shouts > p.n_words),
    Rule("short_words", lambda p: p.word_chars < 2 * p.n_words),
    Rule("long_words", lambda p: p.word_chars > 20 * p.n_words),
)


@dataclass(frozen=True)
class Estimate:
    """What a sample tells of a rule: the figures it asks for and the texts it rejects."""

    rule: Rule
    figures: frozenset[str]
    rejected: tuple[bool, ...]


def estimate(sample: Sequence[str | None], rules: Sequence[Rule]) -> tuple[list[Estimate], dict[str, float]]:
    """Each rule's estimate, and the seconds a text that each figure takes once those it rests on are there."""
    figures = [n for n, v in vars(Profile).items() if isinstance(v, cached_property)]
    seconds = dict.fromkeys(figures, 0.0)
    for text in sample:
        p = Profile(text)
        for f in figures:
            began = time.perf_counter()
            getattr(p, f)
            seconds[f] += (time.perf_counter() - began) / len(sample)
    found = []
    for rule in rules:
        asked, rejected = set(), []
        for text in sample:
            p = Profile(text)
            rejected.append(bool(rule.rejects(p)))
            asked |= vars(p).keys() & seconds.keys()
        found.append(Estimate(rule, frozenset(asked), tuple(rejected)))
    return found, seconds


def order(sample: Sequence[str | None], rules: Sequence[Rule], known: Sequence[str] = ()) -> list[Rule]:
    """Most rejections per second first, of the texts that the rules before have left.

    A rule costs only those of its figures that neither rules before it asked for nor are
    ``known`` anyway.  Rules that reject nothing of what is left come last, cheap ones first.
    The verdict does not depend on the order.
    """
    left, seconds = estimate(sample, rules)
    alive, have, out = [True] * len(sample), set(known), []
    while left:
        cost = {e.rule: sum(seconds[f] for f in e.figures - have) + 1e-8 for e in left}
        share = {e.rule: sum(a and r for a, r in zip(alive, e.rejected, strict=True)) for e in left}
        best = min(left, key=lambda e: (-share[e.rule] / cost[e.rule], cost[e.rule]))
        out.append(best.rule)
        left.remove(best)
        have |= best.figures
        alive = [a and not r for a, r in zip(alive, best.rejected, strict=True)]
    return out


def draw(docs: DataFrame, sample_size: int, seed: int = 7) -> list[str | None]:
    """At most ``sample_size`` texts, for cost and selectivity only."""
    return [r.text for r in docs.select("text").sample(0.05, seed).limit(sample_size).toLocalIterator()]


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_size: int = 300, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row: the ``carry`` columns, the base figures, base_failed, kept and rejected_by.

    The base figures are computed for every row.  The rules then run in the order that
    a sample of ``sample_size`` texts suggests and stop at the first rejection; the sample
    decides only the order, never a verdict.  A null text counts as empty, texts
    without words fail the base, and texts of any length count as a whole.  Repeated rows are
    judged alike; no verdict depends on other rows, so ties cannot occur; other columns do not
    matter; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    ordered = order(draw(docs, sample_size), rules, FIGURES)
    carry = list(carry)
    kind = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"`{c}` bigint" for c in FIGURES), "base_failed boolean", "kept boolean", "rejected_by string"])
    text_at = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(text_at):
                p = Profile(text.as_py())
                base = next((r.name for r in BASE if r.rejects(p)), None)
                out = base or next((r.name for r in ordered if r.rejects(p)), None)
                rows.append((*(getattr(p, f) for f in FIGURES), base is not None, out is None, out))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(text_at)), *made], names=[*carry, *FIGURES, "base_failed", "kept", "rejected_by"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, kind)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_size: int = 300) -> DataFrame:
    """The rows of docs that pass, with their columns as they were, whatever their names.

    The base rules take their place in the order like all others, so the dear ones run only on
    what cheaper ones leave.  Null, empty and wordless texts go, texts of any length are judged as
    a whole, repeated rows stay or go together, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    ordered = order(draw(docs, sample_size), (*BASE, *rules))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at):
                p = Profile(text.as_py())
                keep.append(not any(r.rejects(p) for r in ordered))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
