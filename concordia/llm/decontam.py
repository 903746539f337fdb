"""Operator 8: benchmark decontamination by BM25 and block-max WAND, verified on word overlap."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from concordia.llm import texts as T
from concordia.llm.scratch import small_batches

K1, B = 1.2, 0.75
#: A passage retrieves an item when it holds this share of the item's BM25 mass.
THRESHOLD = 0.6
#: Both question and answer must have this share of their word windows near the passage.
OVERLAP = 0.5
#: Bytes of benchmark text in one index.  More items make more indexes, each of them
#: broadcast and run over all rows in turn.
INDEX_BYTES = 16_000_000
BLOCKS = 24
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence or line is the answer; of a single one, the last third of its words."""
    parts = [w for s in _SENTENCE.split(text) if (w := T.alnum_words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def windows(words: list[bytes], width: int = 5) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


class Statistics:
    """Items with words, their words, and the items that each word is in: of the whole benchmark,
    so that weights do not depend on how many indexes it makes."""

    def __init__(self, texts: Iterable[str | None]):
        self.n, self.words, self.df = 0, 0, Counter()
        for text in texts:
            question, answer = question_answer(text or "")
            if question or answer:
                self.n += 1
                self.words += len(question) + len(answer)
                self.df.update({*question, *answer})


class Index:
    """Inverted index of items; weights are BM25 shares of an item's own score, so 1 is all of it.

    Items are grouped by length, as a passage of a group spans 1.5 times the group's
    longest item, every half of it; then any place of an item lies inside a passage.
    Within a group, items are in blocks; ``bound[t, b]`` is term t's largest weight in block b.
    """

    def __init__(self, items: list[tuple[object, str | None]], of: Statistics | None = None):
        self.items, self.parts, lists = [], [], []
        for item, text in items:
            question, answer = question_answer(text or "")
            if question or answer:
                self.items.append(item)
                self.parts.append((windows(question), windows(answer)))
                lists.append(question + answer)
        of = of or Statistics(t for _, t in items)
        n, df, mean = of.n, of.df, of.words / max(of.n, 1)
        self.terms = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
        groups: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(lists):
            groups[max(16, 1 << (len(x) - 1).bit_length())].append(i)
        self.groups = []
        for size, members in sorted(groups.items()):
            members.sort(key=lambda i: len(lists[i]))
            per = -(-len(members) // BLOCKS)
            n_blocks = -(-len(members) // per)
            bound = np.zeros((len(self.terms) + 1, n_blocks), np.float32)
            posts: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
            for k, i in enumerate(members):
                tf, length = Counter(lists[i]), len(lists[i])
                raw = {
                    w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean)) for w, c in tf.items()
                }
                own = sum(raw.values())
                for w, v in raw.items():
                    t, b = self.terms[w], k // per
                    posts[t, b].append((i, v / own))
                    bound[t, b] = max(bound[t, b], v / own)
            self.groups.append((size, bound, dict(posts)))

    def search(self, words: list[bytes]) -> list[tuple[int, float, int, int]]:
        """(item number, score, first word, end) of every passage and item above the threshold."""
        if not words or not self.items:
            return []
        get = self.terms.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        found = []
        for size, bound, posts in self.groups:
            half = size // 2
            at = np.arange(0, len(ids), half)
            sums = np.add.reduceat(bound[ids], at, axis=0)
            total = sums.copy()
            total[:-1] += sums[1:]
            total[:-2] += sums[2:]
            # Blocks whose maxima cannot reach the threshold are skipped for the passage.
            for p, b in zip(*np.nonzero(total >= THRESHOLD - 1e-4), strict=True):
                begin, end = int(p) * half, int(p) * half + 3 * half
                found += [(i, s, begin, end) for i, s in self._score(ids[begin:end], int(b), bound, posts)]
        return found

    @staticmethod
    def _score(ids: np.ndarray, block: int, bound: np.ndarray, posts: dict) -> list[tuple[int, float]]:
        """Terms by falling maxima; stops when what is left cannot lift any item to the threshold."""
        terms = np.unique(ids)
        most = bound[terms, block]
        order = np.argsort(-most)
        order = order[: np.count_nonzero(most)]
        left = float(most[order].sum())
        if left < THRESHOLD - 1e-4:
            return []
        score: dict[int, float] = defaultdict(float)
        best = 0.0
        for k in order.tolist():
            if best + left < THRESHOLD - 1e-4:
                return []
            for item, weight in posts[int(terms[k]), block]:
                score[item] += weight
                if score[item] > best:
                    best = score[item]
            left -= float(most[k])
        return [(i, s) for i, s in score.items() if s >= THRESHOLD]

    def matches(self, text: str | None) -> list[tuple[object, float, float, float]]:
        """(item id, best score, question overlap, answer overlap) of verified items."""
        words = T.alnum_words(text)
        best: dict[int, tuple[float, float, float]] = {}
        for i, score, begin, end in self.search(words):
            near = words[max(0, begin - 8) : end + 8]
            question, answer = self.parts[i]
            shares = [
                sum(g in there for g in part) / len(part) if part else 1.0
                for part in (question, answer)
                for there in (windows(near, len(next(iter(part), ())) or 1),)
            ]
            if min(shares) >= OVERLAP:
                best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (score, *shares))
        return [(self.items[i], *best[i]) for i in sorted(best)]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of at most about INDEX_BYTES of item text each; the driver holds one at a time, and
    the words of the whole benchmark with their counts."""
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // INDEX_BYTES))
    of = Statistics(r.text for r in rows.select("text").toLocalIterator())
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        yield Index([(r.item_id, r.text) for r in part.toLocalIterator()], of)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leaked item.

    Every passage of every text is a query; block-max WAND retrieves all items above
    THRESHOLD.  A hit stands when the 5-word windows of the item's question and those of
    its answer lie near the passage to OVERLAP or more.  Shorter parts are one window.
    Of several passages with one item the best scored counts.

    Null or empty texts leak nothing; texts of any length are searched as a whole; items
    without words match nothing; ids may be of any type and null; repeated rows give repeated
    results; equal items all match; other columns are ignored; an empty table on either side
    gives no rows.
    """
    small_batches(docs.sparkSession)
    spark, out = docs.sparkSession, None
    id_kind, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    kind = f"doc_id {id_kind}, item_id {item_type.simpleString()}, score double, question_overlap double, answer_overlap double"
    item_arrow = to_arrow_type(item_type)
    for index in indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in held.value.matches(t.as_py())]
                columns = [[r[0].as_py() for r in rows], *([r[i] for r in rows] for i in range(1, 5))]
                types = [batch.column(0).type, item_arrow, pa.float64(), pa.float64(), pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any leaked item, with their columns as they were, whatever their names.

    Null, empty and wordless texts stay, texts of any length are searched as a whole, repeated rows stay
    or go together; without items all rows stay, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    spark, at = docs.sparkSession, docs.columns.index("text")
    for index in indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not held.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
