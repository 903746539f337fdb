"""Small dictionaries as map literals."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def look(values: Mapping[str, object], key: Column) -> Column:
    """values[key], null where there is none."""
    return F.try_element_at(literal_map(values), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: keeps nested expressions from growing exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def title_case(c: Column) -> Column:
    """Lower case with a capital at the start of every run of ASCII word characters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    big = lambda t: F.when(t.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))).otherwise(t)
    return F.array_join(F.transform(runs, big), "")
