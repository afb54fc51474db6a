"""Language identification in two steps: first the family, then one linear support vector machine for each pair within it.

A document is the mean over its words of hashed features: its character trigrams with its edges, and a short word itself.
All machines are linear, so each distinct word has one score for each machine, kept in a table; a document's scores are means of
those rows. Words are runs of letters (Unicode category L) of the whole text in lower case, so digits, numerals, symbols and mark-up
don't count.

Fitted on a bounded sample: of each known language the `per_lang` training ids (never held-out ones) with the least hash, `sample` in
all; only (lang, hash, doc_id) is ranked, and the workers turn the chosen texts into counts. A model has CELLS weights at most: beyond
(hundreds of languages) it keeps the features that weigh most, and a machine sees only some rows of the other classes.

Defined results: a null text or one without a letter is `und` with score 0; so is every text where nothing could be learned. A null
doc_id is not held out and not learned from; of rows that repeat an id in one language the least text teaches. A language without a family in FAMILIES is a family of its own. Rows are independent
of each other, so repeated rows get equal results; other columns are kept as they are by predict().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, least_hashes, slices

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi bn mr gu pa ne ur",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BITS = 18
#: Letters up to which a word is a feature of its own.
SHORT = 6
#: Runs of letters, and of the numerals among which no digit is (such as fractions), which features() leaves out.
LETTERS = re.compile(r"[^\W\d_]+")
PER_LANG, SAMPLE = 300, 3000
#: Rows of other classes that all machines have together, and each at least.
OTHERS, LEAST_OTHERS = 60_000, 200
#: Words, and numbers in all, that a worker keeps scores of; numbers of a model.
CACHE, CELLS = 200_000, 1 << 23
#: A prediction below this is a rejection: no family's machine claims the text.
LEAST_SCORE = 0.2


class Grams(dict):
    """gram -> its bucket. Few grams stand behind many words."""

    def __missing__(self, gram: str) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[gram] = xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass")) >> (64 - BITS)
        return value


def features(word: str, grams: Grams) -> list[int]:
    """Buckets of the trigrams of a word's letters with its edges, and of a short word itself; none without a letter."""
    if not word.isalpha():
        word = "".join(filter(str.isalpha, word))
    edged = f"<{word}>"
    out = [grams[edged[i : i + 3]] for i in range(len(word))]
    if 0 < len(word) <= SHORT:
        out.append(grams[edged])
    return out


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


@dataclass
class Model:
    """Columns of weights: a machine for each family (none for a single one), then one for each pair of languages of a family.

    row: of each bucket its row of weights; row 0 is of buckets without any.
    """

    families: list[str]
    langs: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        if len(self.families) > 1:
            best = int(np.argmax(margins[: len(self.families)]))
            sure, start = float(margins[best]), len(self.families)
        else:
            best, sure, start = 0, np.inf, 0
        votes: Counter = Counter({lang: 0 for lang in self.langs[self.families[best]]})
        margin: Counter = Counter()
        for k, (a, b) in enumerate(self.pairs):
            if a in votes:
                m = float(margins[start + k])
                votes[a if m >= 0 else b] += 1
                margin[a] += m
                margin[b] -= m
        lang = max(votes, key=lambda x: (votes[x], margin[x], x))
        if len(votes) > 1:
            sure = min(sure, margin[lang] / (len(votes) - 1))
        return lang, float(1 / (1 + np.exp(-4 * np.clip(sure, -20, 20))))


class Rows:
    """A sparse matrix of documents: only what a linear machine needs of it."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(docs)
        self.doc = np.repeat(np.arange(self.n), [len(i) for i, _ in docs])
        index = np.concatenate([i for i, _ in docs]) if docs else np.zeros(0, dtype=np.int64)
        self.names, self.col = np.unique(index, return_inverse=True)
        self.value = np.concatenate([v for _, v in docs]) if docs else np.zeros(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, self.value * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.doc], len(self.names))


def machine(rows: Rows, y: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss, both classes with equal weight, by accelerated gradient steps. y: -1 or 1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(len(rows.names)), 0.0
    v, c, step = w.copy(), b, 1.0
    norm = np.bincount(rows.doc, rows.value**2, rows.n).max(initial=0) + 1
    rate = 1 / (2 * norm + penalty)
    for _ in range(rounds):
        loss = np.maximum(0, 1 - y * (rows.times(v) + c))
        g = -2 * share * y * loss
        w2, b2 = v - rate * (rows.back(g) + penalty * v), c - rate * g.sum()
        step2 = (1 + np.sqrt(1 + 4 * step * step)) / 2
        v, c = w2 + (step - 1) / step2 * (w2 - w), b2 + (step - 1) / step2 * (b2 - b)
        w, b, step = w2, b2, step2
    return w, b


def vector(text: str | None, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts by word."""
    total: Counter = Counter()
    n = 0
    for word, k in Counter(words(text)).items():
        found = features(word, grams)
        n += k if found else 0
        for f in found:
            total[f] += k
    index = np.fromiter(total.keys(), dtype=np.int64, count=len(total))
    return index, np.fromiter(total.values(), dtype=np.float64, count=len(total)) / max(1, n)


def learn(sample: Iterator[tuple[str, np.ndarray, np.ndarray]], cells: int = CELLS) -> Model | None:
    """sample: a language and a vector."""
    found = [(lang, (i, v)) for lang, i, v in sample if len(i)]
    if not found:
        return None
    langs = [x for x, _ in found]
    scale = 4 / float(np.mean([np.sqrt((v**2).sum()) for _, (_, v) in found]))
    docs = [(i, v * scale) for _, (i, v) in found]
    lang = np.array(langs)
    family = np.array([FAMILY_OF.get(x, x) for x in langs])
    of: dict[str, list[str]] = {f: sorted(set(lang[family == f])) for f in sorted(set(family))}
    pairs = [(a, b) for own in of.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    tasks = [(None, f) for f in of] if len(of) > 1 else []
    tasks += pairs
    n = max(1, len(tasks))
    most = max(1, cells // n)  # features that are kept
    bias, strong, total = np.zeros(n), [], np.zeros(1 << BITS)
    for k, (a, b) in enumerate(tasks):
        own, other = (np.flatnonzero(family == b), np.flatnonzero(family != b)) if a is None else (np.flatnonzero(lang == a), np.flatnonzero(lang == b))
        if len(other) > (few := max(LEAST_OTHERS, OTHERS // n, len(own))):  # with hundreds of machines each gets some of the others, evenly
            other = other[np.linspace(0, len(other) - 1, few).astype(int)]
        rows = Rows([docs[i] for i in (*own, *other)])
        w, bias[k] = machine(rows, np.repeat([1.0, -1.0], [len(own), len(other)]))
        total[rows.names] += w * w
        best = np.argpartition(-np.abs(w), most)[:most] if len(w) > most else np.arange(len(w))
        strong.append((rows.names[best].astype(np.int32), (w[best] * scale).astype(np.float32)))
    kept = np.flatnonzero(total)
    if len(kept) > most:
        kept = np.sort(np.argpartition(-total, most)[:most])
    row = np.zeros(1 << BITS, dtype=np.int32)
    row[kept] = np.arange(1, len(kept) + 1)
    weights = np.zeros((len(kept) + 1, n), dtype=np.float32)
    for k, (names, w) in enumerate(strong):
        weights[row[names], k] = w
    weights[0] = 0
    return Model(list(of), of, pairs, row, weights, bias)


class WordScores(dict):
    """word -> its row in a table: a score for each machine, then 1, or all 0 if it has no letter."""

    def __init__(self, model: Model):
        self.grams, self.model, self.table = Grams(), model, np.empty((1 << 10, model.weights.shape[1] + 1), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        found = features(word, self.grams)
        self.table[k, :-1] = self.model.weights[self.model.row[found]].sum(axis=0) if found else 0
        self.table[k, -1] = bool(found)
        self[word] = k
        return k


def sums(docs: list[list[str]], known: WordScores, cells: int = CELLS) -> np.ndarray:
    """For each document the sum of its words' rows; of so many words at a time that no array has more than `cells` numbers."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    width = known.table.shape[1]
    out, step = np.zeros((len(docs), width)), max(1, cells // width)
    owner, flat = np.repeat(np.arange(len(docs)), lengths), chain.from_iterable(docs)
    for at in range(0, len(owner), step):
        if len(known) > CACHE or (len(known) + step) * width > 2 * cells:
            known.clear()
        own = owner[at : at + step]
        index = np.fromiter(map(known.__getitem__, islice(flat, len(own))), dtype=np.int64, count=len(own))
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(known.table[index].astype(np.float64), first, axis=0)
    return out


PREDICTED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def scorer(model: Model | None, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(model) if model else None
        for batch in batches:
            for part in slices(batch, text):
                docs = [words(t) for t in part.column(text).to_pylist()]
                langs, scores = ["und"] * len(docs), [0.0] * len(docs)
                if model and any(docs):
                    found = sums(docs, known)
                    for i in np.flatnonzero(found[:, -1]).tolist():
                        langs[i], scores[i] = model.decide(found[i, :-1] / found[i, -1] + model.bias)
                for (name, kind), v in zip((("lang_pred", pa.string()), ("score", pa.float64())), (langs, scores), strict=True):
                    part = part.append_column(pa.field(name, kind), pa.array(v, type=kind))
                yield part

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        for part in slices(batch, "text"):
            found = [vector(t, grams) for t in part.column("text").to_pylist()]
            made = (pa.array([i for i, _ in found], type=pa.list_(pa.int32())), pa.array([v for _, v in found], type=pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("doc_id"), *made], names=["lang", "doc_id", "bucket", "share"])


def fit(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> Model | None:
    """A model from docs (doc_id, text, lang) that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = least_hashes(known.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id"), "lang", "h", per_lang, sample)
    chosen = {(r.lang, r.doc_id) for r in first.orderBy("k", "lang").limit(sample).collect()}
    if not chosen:
        return None
    texts = known.where(F.col("doc_id").isin(list({i for _, i in chosen}))).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(lean(vectors), "lang string, doc_id long, bucket array<int>, share array<double>").toArrow()
    lang, ids = (found.column(c).to_pylist() for c in ("lang", "doc_id"))
    bucket, share = (found.column(c).combine_chunks() for c in ("bucket", "share"))
    order = sorted((k for k in range(len(ids)) if (lang[k], ids[k]) in chosen), key=lambda k: (ids[k], lang[k]))
    return learn((lang[k], np.asarray(bucket[k].values, dtype=np.int64), np.asarray(share[k].values, dtype=np.float64)) for k in order)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (any columns, with text), lang_pred and score."""
    own = docs.drop("lang_pred", "score")
    return own.mapInArrow(lean(scorer(model, "text")), T.StructType([*own.schema.fields, *PREDICTED]))


def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [any(any(map(str.isalpha, m[0])) for m in LETTERS.finditer(t or "")) for t in part.column("text").to_pylist()]
            yield part.filter(pa.array(found, type=pa.bool_()))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter: those that predict could call other than `und`."""
    return docs.mapInArrow(lean(lettered), docs.schema)
