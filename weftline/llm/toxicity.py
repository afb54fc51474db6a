"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w x - cut_k): the weights w of the sparse features are shared by all thresholds, which are kept in order. The
features are the distinct words of the whole text, hashed; expected severity is the sum of P(grade > k). Grades of the training rows:
0 where toxic is 0; a toxic row has grade 1 or 2, as it has at most or more distinct marker words (words that stand in a far larger
share of the toxic training rows) than the median of the toxic rows that have any.

Fitted on a bounded sample: of labelled rows of each class the `per_class` with the least hash of their id. Scoring keeps each
distinct word's weight in a table.

Defined results: a null or empty text has severity 0 and isn't toxic; without toxic and clean training rows everything is 0. Labels
without an id or a value are left out; of an id labelled twice, toxic wins; of rows that repeat an id the least text teaches. Rows are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, lean, least_hashes, slices

BITS = 18
PER_CLASS = 2500
GRADES = 3
#: A word is a feature if its share of the toxic training rows is above its share of the others by so many standard errors, and it stands
#: in such a share of the rarer class. Most words pass neither; and no number of harmless words makes a text less toxic.
SCREEN, SUPPORT = 5.0, 0.02
CACHE = 300_000
#: P(grade > 0) from which on a text counts as toxic: a missed one costs more than a second look at a clean one.
TOXIC_FROM = 0.3


def feature(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - BITS)


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray


class WordWeights(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = float(self.weights[feature(word)])
        return value


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(docs: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, rounds: int = 400, penalty: float = 3e-5) -> Model:
    """docs: the features of each. Gradient steps with momentum (Adam) on the cumulative logits."""
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    names, col = np.unique(np.concatenate(docs).astype(np.int64), return_inverse=True)
    w = np.zeros(len(names))
    raw = np.r_[0.0, np.zeros(n_grades - 2)]  # the first cut, then logs of the steps up
    above = (grades[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    m, v = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    for t in range(1, rounds + 1):
        steps = np.exp(raw[1:])
        cuts = np.cumsum(np.r_[raw[0], steps])
        score = np.bincount(doc, w[col], len(docs))
        error = (sigmoid(score[:, None] - cuts[None, :]) - above) / len(docs)
        per_cut = -error.sum(axis=0)
        gw = np.bincount(col, error.sum(axis=1)[doc], len(w)) + penalty * w
        # a step moves its own cut and all above it
        tail = np.cumsum(per_cut[::-1])[::-1]
        g = np.r_[gw, tail[0], tail[1:] * steps]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, raw = w - move[: len(w)], raw - move[len(w) :]
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[names] = w
    return Model(weights, np.cumsum(np.r_[raw[0], np.exp(raw[1:])]))


def learn(sample: list[tuple[int, np.ndarray]], odds: float | None = None) -> Model | None:
    """sample: toxic and the features, each once. odds: of toxic among all labels, where the sample's differ."""
    toxic = np.array([t for t, _ in sample])
    if not len(toxic) or not (toxic == 1).any() or not (toxic == 0).any():
        return None
    sets = [f for _, f in sample]
    seen = [np.bincount(np.concatenate([s for s, t in zip(sets, toxic, strict=True) if t == c]), minlength=1 << BITS) / max(1, (toxic == c).sum()) for c in (0, 1)]
    n = (toxic == 1).sum()
    clean = len(toxic) - n
    both = (seen[0] * clean + seen[1] * n) / len(toxic)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n + 1 / clean))
    common = seen[1] - seen[0] >= SCREEN * error
    common &= both * len(toxic) >= max(3, SUPPORT * min(n, clean))
    if not common.any():
        return None
    sets = [x[common[x]] for x in sets]
    markers = np.array([len(x) for x in sets])
    some = markers[(toxic == 1) & (markers > 0)]
    grades = np.where(toxic == 1, 1 + (markers > np.median(some) if len(some) else 0), 0)
    model = fit_ordinal(sets, grades)
    if odds:
        model.cuts += np.log(n / (len(toxic) - n) / odds)
    return model


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text, each once."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [sorted({feature(w) for w in set(alnum_words(t))}) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, type=pa.list_(pa.int32()))], names=["doc_id", "words"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("_of"))
    chosen = {r["_of"]: r["toxic"] for r in least_hashes(known, "toxic", "h", per_class, 2).collect()}
    if not chosen:
        return None
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    texts = docs.where(F.col("doc_id").isin(list(chosen))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    rows = texts.mapInArrow(lean(counted), "doc_id long, words array<int>").toArrow()
    ids, words = rows.column("doc_id").to_pylist(), rows.column("words").combine_chunks()
    sample = {i: (chosen[i], np.asarray(words[k].values, dtype=np.int64)) for k, i in enumerate(ids)}
    return learn([sample[i] for i in sorted(sample)], count.get(1, 0) / max(1, count.get(0, 0)) or None)


FOUND = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]


def scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = WordWeights(model.weights).__getitem__ if model else None
        for batch in batches:
            for part in slices(batch, "text"):
                words = [set(alnum_words(t)) for t in part.column("text").to_pylist()]
                above = np.zeros((len(words), GRADES - 1))
                full = np.array([bool(w) for w in words], dtype=bool)
                if model and full.any():
                    score = np.array([sum(map(weight, w)) for w in words])
                    above[full] = sigmoid(score[full, None] - model.cuts[None, :])
                made = (pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0] >= TOXIC_FROM))
                for f, v in zip(FOUND, made, strict=True):
                    part = part.append_column(f.name, v)
                yield part

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (any columns, with text), severity (0 to 2), p_toxic, grade and toxic."""
    own = docs.drop(*[f.name for f in FOUND])
    return own.mapInArrow(lean(scorer(model)), T.StructType([*own.schema.fields, *FOUND]))
