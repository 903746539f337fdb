"""String similarity and phonetic codes.

Edit distance and Soundex are built in; Jaro, the weighted distance, edit scripts and the two
rule-based phonetic codes have no built-in form and run as Arrow-batched UDFs, once per
distinct input of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# --- edit distance ----------------------------------------------------------


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the lengths allow that similarity; lossless."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.abs(F.length(a) - F.length(b)) <= (1 - threshold) * longest + 1e-9


def _pairs(f: Callable, a: pd.Series, b: pd.Series) -> list:
    seen: dict = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in seen:
            seen[x, y] = f(x, y)
        out.append(seen[x, y])
    return out


def _table(a: str, b: str, insert: float, delete: float, change: float) -> np.ndarray:
    """cost[i, j] of turning a[:i] into b[:j], by anti-diagonal-free row updates."""
    cost = np.zeros((len(a) + 1, len(b) + 1))
    cost[:, 0] = np.arange(len(a) + 1) * delete
    cost[0] = np.arange(len(b) + 1) * insert
    other = np.array(list(b))
    for i, ch in enumerate(a, 1):
        best = np.minimum(cost[i - 1, 1:] + delete, cost[i - 1, :-1] + np.where(other == ch, 0, change))
        # Insertions run along the row: a running minimum after taking off their cost.
        steps = np.arange(1, len(b) + 1) * insert
        row = np.minimum.accumulate(np.concatenate(([cost[i, 0]], best - steps)))
        cost[i, 1:] = row[1:] + steps
    return cost


def weighted_distance(a: Column, b: Column, insert: float = 1.0, delete: float = 1.0, change: float = 1.0) -> Column:
    """Edit distance with costs of its own for each operation."""

    @pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_pairs(lambda s, t: float(_table(s, t, insert, delete, change)[-1, -1]), x, y), dtype="float64")

    return run(a, b)


def script(a: str, b: str) -> list[dict]:
    """Operations that turn a into b; on equal cost a change goes before an insertion, that before a deletion."""
    cost, i, j, out = _table(a, b, 1, 1, 1), len(a), len(b), []
    while i or j:
        same = i > 0 and j > 0 and a[i - 1] == b[j - 1]
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (not same):
            i, j = i - 1, j - 1
            out.append({"op": "match" if same else "substitute", "place": i, "char": b[j]})
        elif j and cost[i, j] == cost[i, j - 1] + 1:
            j -= 1
            out.append({"op": "insert", "place": i, "char": b[j]})
        else:
            i -= 1
            out.append({"op": "delete", "place": i, "char": a[i]})
    return out[::-1]


#: What an edit script holds.
OPERATIONS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("char", T.StringType())]))


@pandas_udf(OPERATIONS)
def edit_script(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_pairs(script, a, b))


# --- Jaro -------------------------------------------------------------------


def jaro_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = list(b)
    hit_a = []
    hit_b = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == ch:
                free[j] = None
                hit_a.append(ch)
                hit_b.append(j)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(hit_a, sorted(hit_b), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity."""
    return pd.Series(_pairs(jaro_of, a, b), dtype="float64")


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    """Length of the common prefix, at most ``most``."""
    flags = [F.when((F.substring(a, 1, k) == F.substring(b, 1, k)) & (F.length(a) >= k) & (F.length(b) >= k), 1).otherwise(0) for k in range(1, most + 1)]
    return sum(flags[1:], flags[0])


def jaro_winkler(a: Column, b: Column, scale: float = 0.1, most: int = 4) -> Column:
    """Jaro plus the prefix boost, without a threshold for the boost."""
    j = jaro(a, b)
    return F.when(a == b, 1.0).otherwise(j + common_prefix(a, b, most) * scale * (1 - j))


# --- phonetic codes ---------------------------------------------------------


def soundex(c: Column) -> Column:
    """Soundex of the letters; 0000 where there is none."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    return F.when(letters == "", "0000").otherwise(F.soundex(letters))


#: Sounds by their spellings in context, first match wins.
METAPHONE = (
    (r"^[AEIOU]", None), (r"[AEIOU]", ""), (r"(?<=M)B$", ""), (r"B", "B"), (r"CH", "X"), (r"C(?=IA)", "X"), (r"(?<!S)C(?=[IEY])", "S"), (r"C", "K"),
    (r"DG[EIY]", "J"), (r"D", "T"), (r"F", "F"), (r"G(?=H[^EIY])", ""), (r"G(?=N$)", ""), (r"G(?=[EIY]|$)", "J"), (r"G", "K"),
    (r"(?:^|(?<=[AEIOU]))H(?=[AEIOU]|$)", "H"), (r"H", ""), (r"J", "J"), (r"(?<!C)K", "K"), (r"K", ""), (r"L", "L"), (r"M", "M"), (r"N", "N"),
    (r"PH", "F"), (r"P", "P"), (r"Q", "K"), (r"R", "R"), (r"S(?=H|I[AO])", "X"), (r"S", "S"), (r"TH", "0"), (r"T(?=I[AO])", "X"), (r"T", "T"),
    (r"V", "F"), (r"W(?=[AEIOU]|$)", "W"), (r"W", ""), (r"X", "KS"), (r"Y(?=[AEIOU]|$)", "Y"), (r"Y", ""), (r"Z", "S"),
)
#: The same for the second code, after its prefixes and suffixes.
NYSIIS = (
    (r"^[AEIOU]", "A"), (r"[AEIOU]", ""), (r"Q", "G"), (r"Z", "S"), (r"M", "N"), (r"KN", "N"), (r"K", "C"), (r"SCH", "S"), (r"PH", "F"),
    (r"[A-Z]", None),
)
NYSIIS_PREFIXES = (("MAC", "MCC"), ("KN", "N"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS"))
NYSIIS_SUFFIXES = (("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D"))


def _scanner(rules: tuple[tuple[str, str | None], ...]) -> Callable[[str, int, int], str]:
    """One pass over a word; a rule without a sound keeps the letters."""
    pattern = re.compile("|".join(f"({p})" for p, _ in rules))

    def run(word: str, begin: int = 0, most: int = 1 << 30) -> str:
        out = ""
        for m in pattern.finditer(word, begin):
            if len(out) >= most:
                break
            sound = rules[m.lastindex - 1][1]
            out += m.group() if sound is None else sound
        return out

    return run


_metaphone, _nysiis = _scanner(METAPHONE), _scanner(NYSIIS)


def metaphone_of(word: str) -> str:
    """A four-sound Metaphone with simplified rules."""
    letters = re.sub("[^A-Z]", "", word.upper())
    if letters.startswith("X"):
        return "S" + _metaphone(letters, 1, 3)
    return _metaphone(letters, int(letters[:2] in ("KN", "GN", "PN", "AE", "WR")), 4)


def nysiis_of(word: str) -> str:
    """A six-letter NYSIIS with simplified rules."""
    letters = re.sub("[^A-Z]", "", word.upper())
    head = next(((p, r) for p, r in NYSIIS_PREFIXES if letters.startswith(p)), ("", ""))
    letters = head[1] + letters[len(head[0]) :]
    tail = next(((s, r) for s, r in NYSIIS_SUFFIXES if letters.endswith(s)), ("", ""))
    letters = letters[: len(letters) - len(tail[0])] + tail[1]
    code = re.sub(r"(.)\1+", r"\1", _nysiis(letters))
    for end, new, least in (("S", "", 1), ("AY", "Y", 2), ("A", "", 1)):
        if code.endswith(end) and len(code) > least:
            code = code[: -len(end)] + new
    return code[:6]


@pandas_udf(T.StringType())
def metaphone(words: pd.Series) -> pd.Series:
    codes = {w: metaphone_of(w) for w in words.dropna().unique()}
    return words.map(codes)


@pandas_udf(T.StringType())
def nysiis(words: pd.Series) -> pd.Series:
    codes = {w: nysiis_of(w) for w in words.dropna().unique()}
    return words.map(codes)


def phonetic_equal(a: Column, b: Column, code: Callable[[Column], Column] = soundex) -> Column:
    """1.0 if the codes are equal, else 0.0."""
    return (code(a) == code(b)).cast("int").cast("double")


# --- tokens and the mixed score ---------------------------------------------


def tokens(c: Column) -> Column:
    """Lower-cased tokens of a column name, split at case changes and marks, and their 3-letter starts."""
    apart = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.concat(words, F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.substring(w, 1, 3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either array is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Weights of the mixed score.
WEIGHTS = {"jaro_winkler": 0.4, "edit": 0.4, "phonetic": 0.2}


def mixed(a: Column, b: Column, weights: dict[str, float] = WEIGHTS, threshold: float = 0.75) -> Column:
    """similarity, confidence, is_match and the three parts of the mixed score."""
    total = sum(weights.values())
    jw, ed, ph = jaro_winkler(a, b), edit_similarity(a, b), phonetic_equal(a, b)
    same = a == b
    score = (jw * weights["jaro_winkler"] + ed * weights["edit"] + ph * weights["phonetic"]) / total
    mean = (jw + ed + ph) / 3
    spread = F.sqrt((F.pow(jw - mean, 2) + F.pow(ed - mean, 2) + F.pow(ph - mean, 2)) / 3)
    return F.struct(
        F.when(same, 1.0).otherwise(score).alias("similarity"),
        F.when(same, 1.0).otherwise(mean * 0.7 + (1 - F.least(spread, F.lit(1.0))) * 0.3).alias("confidence"),
        (same | (score >= threshold)).alias("is_match"),
        F.when(same, 1.0).otherwise(jw).alias("jaro_winkler"),
        F.when(same, 1.0).otherwise(ed).alias("edit"),
        F.when(same, 1.0).otherwise(ph).alias("phonetic"),
    )
