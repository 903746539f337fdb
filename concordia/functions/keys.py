"""Normalizers of join keys: Column to Column, all inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street words that the address normalizer leaves out.
STREET_WORDS = ("street", "st", "avenue", "ave", "road", "rd", "drive", "dr", "lane", "ln", "boulevard", "blvd")
#: Accepted spellings of dates, first match wins.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "d-MMM-yyyy")

Normalizer = Callable[[Column], Column]


def _text(c: Column) -> Column:
    return c.cast("string")


def email(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(_text(c)), r"\s+", "")


def phone(c: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(_text(c), "[^0-9]", "")


def name(c: Column) -> Column:
    """Lower case, word characters and single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(c))), r"[^\w\s]", ""), r"\s+", " ")


def address(c: Column) -> Column:
    """Lower case, punctuation as blanks, street words left out, single blanks."""
    plain = F.regexp_replace(F.lower(F.trim(_text(c))), r"[^\w\s]", " ")
    return F.regexp_replace(F.regexp_replace(plain, rf"\b({'|'.join(STREET_WORDS)})\b", ""), r"\s+", " ")


def numeric(c: Column) -> Column:
    """Two decimals of the leading number; '0' where there is none."""
    lead = F.regexp_extract(_text(c), r"^\s*([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)", 1)
    value = lead.try_cast("double")
    return F.when(value.isNotNull(), F.format_string("%.2f", F.coalesce(value, F.lit(0.0)))).otherwise(F.lit("0"))


def date(c: Column) -> Column:
    """yyyy-MM-dd in UTC; empty where no format fits."""
    tries = [F.try_to_timestamp(_text(c), F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.lit(""))


def categorical(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.trim(_text(c)))


def default(c: Column) -> Column:
    """Lower case, single blanks."""
    return F.regexp_replace(F.lower(F.trim(_text(c))), r"\s+", " ")


NORMALIZERS: dict[str, Normalizer] = {f.__name__: f for f in (email, phone, name, address, numeric, date, categorical, default)}


def register(label: str, normalizer: Normalizer) -> None:
    """Add a normalizer; prefer Column expressions, else a pandas_udf."""
    NORMALIZERS[label] = normalizer


def normalize(c: Column, kind: str) -> Column:
    """The named normalizer; unknown names use ``default``."""
    return NORMALIZERS.get(kind, default)(c)
