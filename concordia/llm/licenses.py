"""Operator 5: licence scans by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from concordia.llm import texts as T
from concordia.llm.scratch import small_batches

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases and their labels.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "proprietary and confidential": "proprietary",
}
#: The tag before a licence expression, as words.
TAG = "spdx license identifier"
#: How free the licences are to use, by label of a notice or identifier family.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "public-domain": 1.0,
    "cc-by": 0.9, "cc": 0.7, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5,
    "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN = 0.2
#: What an exception adds to its licence.
EXCEPTION = 0.2
#: The tag as it is written, in any case.
_WRITTEN = "spdx-license-identifier"
_COLON = re.compile(r"\s*:[^\S\n]*")
#: Words of a text as it is, before A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:\-]+")


def family(identifier: str) -> str:
    """The label of a licence identifier: its name without version and suffixes."""
    name = identifier.lower().rstrip("+")
    for label in sorted(FREEDOM, key=len, reverse=True):
        if name == label or name.startswith(label + "-"):
            return label
    return name


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: WITH binds tighter than AND, AND tighter than OR; None if malformed."""
    rank, out, stack, operand = {"OR": 1, "AND": 2, "WITH": 3}, [], [], True
    for token in tokens:
        word = token.upper()
        if word in rank:
            if operand:
                return None
            while stack and stack[-1] != "(" and rank[stack[-1]] >= rank[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def expression(text: str, begin: int = 0, end: int | None = None) -> tuple[list[str], float] | None:
    """(labels, freedom) of the longest well-formed expression at the start of text[begin:end].

    AND takes the less free side, OR the freer one, WITH adds an exception to its licence.
    """
    # Prose may follow on the line: stop where an operand follows an operand, or nothing
    # that follows can be well-formed.  ``whole`` tokens are the longest well-formed start.
    tokens, whole, depth, operand = [], 0, 0, False
    for found in _TOKEN.finditer(text, begin, len(text) if end is None else end):
        token = found.group()
        joins = token.upper() in ("AND", "OR", "WITH")
        if operand != (joins or token == ")"):
            break
        depth += (token == "(") - (token == ")")
        if depth < 0:
            break
        operand = not joins and token != "("
        tokens.append(token)
        if operand and not depth:
            whole = len(tokens)
    postfix = to_postfix(tokens[:whole])
    if not postfix:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in ("AND", "OR"):
            (lb, b), (la, a) = stack.pop(), stack.pop()
            few, many = sorted((la, lb), key=len)
            many |= few
            stack.append((many, min(a, b) if token == "AND" else max(a, b)))
        elif token == "WITH":
            (_, _), (la, a) = stack.pop(), stack.pop()
            stack.append((la, min(1.0, a + EXCEPTION)))
        else:
            label = family(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    labels, value = stack[0]
    return sorted(labels), value


def tagged_expressions(text: str, at: list[int]) -> Iterator[tuple[list[str], float]]:
    """expression() after every tag, up to the end of its line or the next tag.

    ``at`` holds the numbers of the words at which the automaton found a tag's words; it is a
    tag if it is written with hyphens and a colon follows.
    """
    words, tags = [m.span() for m in _WORD.finditer(text)], []
    for k in at:
        begin, end = words[k][0], words[k + 2][1]
        if text[begin:end].lower() == _WRITTEN and (colon := _COLON.match(text, end)):
            tags.append((begin, colon.end()))
    for (_, begin), then in zip(tags, [*(t[0] for t in tags[1:]), len(text)], strict=False):
        line = text.find("\n", begin, then)
        if got := expression(text, begin, then if line < 0 else line):
            yield got


@cache
def automaton() -> ahocorasick.Automaton:
    """Aho-Corasick over the phrases, each with a blank on both sides so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES, TAG: None}.items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = T.alnum_words(text)
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    places, base, labels, values, tags = [], set(), set(), [], []
    for end, (phrase, label, is_base) in automaton().iter(joined):
        if label is None:
            tags.append(end - len(phrase) - 1)
            continue
        if is_base:
            places.append(end - len(phrase) - 1)
            base.add(label)
        labels.add(label)
        values.append(FREEDOM[label])
    at = lambda i: joined.count(" ", 0, i)
    if tags:
        for found, value in tagged_expressions(text, [at(i) for i in tags]):
            labels.update(found)
            values.append(value)
    return (
        len(words), len(places), at(min(places)) if places else None, at(max(places)) if places else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=0.0),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.  One
    Aho-Corasick pass over the whole text finds notice phrases and identifier tags;
    the expression after each tag, however long, is parsed and evaluated up to the end of its
    line or the next tag.  ``score`` is the freedom (0 to 1)
    of the least free licence found, 0 where there is none.

    A null or empty text has no words, no labels and score 0; texts of any length are scanned as a
    whole; overlapping places all count; repeated rows are scanned alike; other columns are
    ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            columns = list(zip(*(scan(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * 7
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, kind)
