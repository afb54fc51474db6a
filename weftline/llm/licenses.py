"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

The automaton runs once over each whole text, as its lower-case words between single spaces, so a phrase is found wherever its words
stand one after another, overlaps included. Where it meets the words of an identifier tag, the expression behind each tag of the raw
text is read up to where its line stops being one, brought into postfix order (with binds closer than and, and closer than or) and
evaluated: `or` lets the reader choose the freer side, `and` binds to the stricter one, `with` takes a step off for its exception.
Each text is passed over a fixed number of times, however many phrases and tags it has.

An operand is an identifier of a known family, a LicenseRef, or a name with a version (Strange-1.0); any other word is prose and ends
the expression, as does a word behind a full one. Behind `with` a word with a hyphen is an exception.

score: how strict the strictest notice is, 0 (none) over permissive 0.25, weak copyleft 0.5 and copyleft 0.75 to 1 (reserved rights);
an unknown identifier counts 0.9.

Defined results: a null or empty text has no words, labels or places; a tag followed by prose says nothing; one followed by the
start of an expression that never gets whole, such as (MIT, gives no label and counts as unknown; rows are independent of each other,
and other columns are kept by scan().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import alnum_words, lean, slices

# The phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "bsl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain dedication": "public-domain",
    "unlicense": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
TAG_HERE, LINE_END = re.compile(r"spdx-license-identifier:", re.I), re.compile(r"[\r\n]|\Z")

# How strict a licence family is.
STRICT = {
    0.1: "cc0 public-domain unlicense 0bsd wtfpl",
    0.25: "mit apache bsd isc bsl zlib cc-by ms-pl python postgresql x11",
    0.5: "lgpl mpl epl cddl cc-by-sa",
    0.75: "gpl agpl cc-by-nd sspl eupl osl",
    1.0: "reserved cc-by-nc proprietary",
}
STRICTNESS = {name: level for level, names in STRICT.items() for name in names.split()}
UNKNOWN = 0.9
BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
#: What an identifier outside the known families looks like.
NAMED = re.compile(r"(?:documentref-[^:]+:)?licenseref-.+|[a-z][a-z0-9]*(?:-[a-z0-9.]+)*-v?\d+(?:\.\d+)*\+?(?:-only|-or-later)?", re.I)


def family(identifier: str) -> str:
    """The longest known family that an identifier starts with; the identifier in lower case if none."""
    low = identifier.lower().rstrip("+.:")
    known = [f for f in STRICTNESS if low == f or low.startswith(f"{f}-")]
    return max(known, key=len, default=low)


def is_licence(token: str) -> bool:
    return family(token) in STRICTNESS or bool(NAMED.fullmatch(token.rstrip(".:")))


def expression(text: str, first: int = 0, end: int | None = None) -> tuple[list[str], bool]:
    """The longest expression that text[first:end] starts with, in tokens (none if there is no whole one), and whether one starts there at all."""
    tokens: list[str] = []
    whole, depth, operand, exception = 0, 0, True, False  # operand: one must come next; exception: behind `with`
    for m in TOKEN.finditer(text, first, len(text) if end is None else end):
        token, low = m[0], m[0].lower()
        if operand:
            if token == "(" and not exception:
                depth += 1
            elif low in BINDS or not ("-" in token if exception else is_licence(token)):
                break
            else:
                operand = exception = False
        elif token == ")" and depth:
            depth -= 1
        elif low in BINDS:
            operand, exception = True, low == "with"
        else:
            break
        tokens.append(token)
        if not operand and not depth:
            whole = len(tokens)
    return tokens[:whole], bool(tokens)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard over the tokens of a whole expression."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        low = token.lower()
        if low in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(text: str, first: int = 0, end: int | None = None) -> tuple[set[str], float]:
    """The licence families that bind by the expression that text[first:end] starts with, and how strict they are together."""
    tokens, started = expression(text, first, end)
    if not tokens:
        return set(), UNKNOWN if started else 0.0
    stack: list[tuple[set[str], float]] = []
    for token in postfix(tokens):
        if token in BINDS:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((a, max(0.0, x - 0.25)))
            elif token == "and":
                stack.append((a | b, max(x, y)))
            else:
                stack.append((a, x) if x < y else (b, y) if y < x else (a | b, x))
        else:
            name = family(token)
            stack.append(({name}, STRICTNESS.get(name, UNKNOWN)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan_text(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, str]], set[str], float]:
    """Number of words, places and labels of the base phrases, all labels, score."""
    words = alnum_words(text)
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    places, labels, score, tagged = [], set(), 0.0, False
    found = sorted((end - len(phrase) - 1, end, phrase) for end, phrase in machine.iter(joined))
    word, counted = 0, 0  # spaces before `counted`
    for k, (start, end, phrase) in enumerate(found):
        if phrase == TAG:
            tagged = True
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        if phrase in BASE:
            word, counted = word + joined.count(" ", counted, start), start
            places.append((word, label))
        elif k + 1 < len(found) and found[k + 1][0] == start:  # a longer notice starts here, such as cc by nc for cc by
            continue
        labels.add(label)
        score = max(score, STRICTNESS[label])
    line_end = -1
    for m in TAG_HERE.finditer(text) if tagged else ():
        if line_end < m.end():
            line_end = LINE_END.search(text, m.end()).start()
        own, strict = evaluate(text, m.end(), line_end)
        labels |= own
        score = max(score, strict)
    return len(words), places, labels, score


FOUND = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
FOUND_SPARK = [T.StructField(k, {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}[v]) for k, v in FOUND.items()]


def finder(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for t in part.column(text).to_pylist():
                    n, places, labels, score = scan_text(t, machine)
                    at = [p for p, _ in places]
                    rows.append((n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score))
                for (name, kind), v in zip(FOUND.items(), zip(*rows, strict=True), strict=True):
                    part = part.append_column(pa.field(name, kind), pa.array(v, type=kind))
                yield part

    return run


def scan(docs: DataFrame) -> DataFrame:
    """docs (any columns, with text), n_words, n_base, first_word, last_word, base_labels, labels and score."""
    own = docs.drop(*FOUND)
    return own.mapInArrow(lean(finder("text")), T.StructType([*own.schema.fields, *FOUND_SPARK]))
