"""Similarity and shapes of names. Names are metadata, a few per table, so most of this is plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that a key column's name may have; the first that fits goes.
KEY_ENDINGS = ("_id", "id", "id_", "_key", "_fk", "key", "fk")
REFERENCE_ENDINGS = ("_id", "Id", "ID", "_ids", "Ids", "IDS", "Ref", "_ref")


def jaro_winkler(a: str, b: str) -> float:
    """1 for equal names; names of which one holds the other have 0.85 to 1 by their lengths; else Jaro with a prefix bonus."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    short, long_ = sorted((len(a), len(b)))
    if a in b or b in a:
        return min(0.85 + 0.15 * short / long_, 1.0) if short else 0.85
    reach = long_ // 2 - 1
    if reach < 0:
        return 0.0
    free = list(range(len(b)))
    pairs = []
    for i, c in enumerate(a):
        j = next((j for j in free if abs(i - j) <= reach and b[j] == c), None)
        if j is not None:
            free.remove(j)
            pairs.append((i, j))
    if not pairs:
        return 0.0
    m, swapped = len(pairs), sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    prefix = next((k for k in range(min(4, short)) if a[k] != b[k]), min(4, short))
    return jaro + prefix * 0.1 * (1 - jaro)


def stem(name: str) -> str:
    """A name without its key ending and its plural s."""
    low = name.lower()
    ending = next((e for e in KEY_ENDINGS if low.endswith(e)), "")
    low = low[: len(low) - len(ending)]
    return low[:-1] if len(low) > 1 and low.endswith("s") else low


def stem_expr(name: Column) -> Column:
    """stem() over a column of names."""
    low = F.lower(name)
    cut = F.regexp_replace(low, "(" + "|".join(f"(?<!_){e}" if e in ("id", "key", "fk") else e for e in KEY_ENDINGS) + ")$", "")
    return F.when(F.length(cut) > 1, F.regexp_replace(cut, "s$", "")).otherwise(cut)


def singular(name: str) -> str:
    return name[:-3] + "y" if name.endswith("ies") else name[:-1] if len(name) > 1 and name.endswith("s") else name


def name_evidence(field: str, parent: str) -> dict[str, float | bool]:
    """What a column's name says about a reference to a table."""
    low, one = field.lower(), parent.lower()[:-1] if len(parent) > 1 and parent.lower().endswith("s") else parent.lower()
    exact = stem(field) == stem(parent) or low in (parent.lower(), one)
    return {
        "similarity": jaro_winkler(stem(field), stem(parent)),
        "suffix": field.endswith(REFERENCE_ENDINGS) or low in {f"{t}{e}" for t in (parent.lower(), one) for e in ("id", "_id")} | {f"{one}{e}" for e in ("ids", "_ids")},
        "exact": exact,
        "containment": one in low or stem(field) in one,
    }


def tokens(name: str) -> list[str]:
    """Lower-case words of a field's name: at _ - . and blanks, and where a capital follows a small letter."""
    return [t for t in re.split(r"[_\-.\s]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if t]
