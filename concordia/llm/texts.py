"""Words, lower case and byte tables that several operators share."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and ASCII that is neither letter nor digit becomes a blank.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """words() with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, ASCII digits and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def odd(seed: int, n: int, dtype) -> np.ndarray:
    """n seeded odd multipliers."""
    top = np.iinfo(dtype).max
    return np.random.default_rng(seed).integers(1, top, n, dtype=dtype, endpoint=True) | dtype(1)


def fresh(columns: list[str], *names: str) -> str | list[str]:
    """Names for helper columns that clash with none of ``columns``, whatever their case."""
    taken, made = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made[0] if len(made) == 1 else made
