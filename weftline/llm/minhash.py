"""Near-duplicate groups of documents by circulant MinHash.

Signatures: every coordinate comes from the same two permutations of the 32-bit universe. The first scatters the shingles, the
second, read from a place that moves on by one with each coordinate, ranks them; so K coordinates need two permutations, not K.
Candidates: documents that agree in all rows of a band. Documents with equal shingle sets count as one from the start, so that
thousands of copies cost one row. Confirmation: the candidates that hang together are brought together once, with whole texts,
and compared on their full sets of 64-bit shingle hashes; other texts aren't shuffled, but for a few that a sieve lets through. What hangs together in too large a group for one task is compared
bucket by bucket, in pairs of blocks of bounded size, so nothing is left out and no task grows with the data.

Defined results: a null or empty text has no shingles and is linked with nothing; one of fewer than `width` words has its whole
sequence as one shingle; rows that repeat a doc_id are one document; a null doc_id is linked with nothing (component_id null,
kept true). Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, lean, materialize, plain_words, sift, slices

#: 36 bands of 5 rows: two documents that share 80 % of their shingles miss each other with a chance below 1e-6.
BANDS, ROWS = 36, 5
#: A group up to these sizes is compared in one task; a larger one in pairs of blocks.
GROUP_DOCS, GROUP_SHINGLES = 4000, 4_000_000
SALTS = 16
#: Distinct words whose hashes a worker remembers.
CACHE = 300_000

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hi", T.LongType()), T.StructField("set_lo", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(texts: list[str | None], known: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts one after another, repeats included, and how many each text has."""
    words = [plain_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    total = int(lengths.sum())
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=total)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    span = np.repeat(np.minimum(lengths, width), counts).astype(np.uint64)
    out = np.full(len(at), 0x9E3779B97F4A7C15, dtype=np.uint64) + span
    for k in range(width):
        word = h[np.minimum(at + k, max(total - 1, 0))] if total else h
        out = np.where(span > k, mix64(out ^ word) * np.uint64(0x9FB21C651E98DF25), out)
    return out, counts


def scatter32(x: np.ndarray) -> np.ndarray:
    """The first permutation of 0 .. 2^32 - 1: odd multiplications and xor-shifts can all be undone."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


def rank32(x: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    return np.bitwise_xor(x, tmp, out=x)


def signatures(h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """One row of n coordinates for each text that has shingles."""
    own = counts[counts > 0]
    starts = np.cumsum(own) - own
    out = np.empty((len(own), n), dtype=np.uint32)
    # texts a few at a time, so that the scratch arrays stay in the processor's cache
    edges = [0, *(np.flatnonzero(np.diff(starts // 100_000)) + 1), len(own)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        lo, hi = int(starts[a]), int(starts[b - 1] + own[b - 1])
        base = scatter32((h[lo:hi] >> np.uint64(32)).astype(np.uint32))
        x, tmp = np.empty_like(base), np.empty_like(base)
        for k in range(n):
            np.add(base, np.uint32(k), out=x)  # the circular shift: modulo 2^32
            out[a:b, k] = np.minimum.reduceat(rank32(x, tmp), starts[a:b] - lo)
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), (len(sig), 1))
    for r in range(rows):
        out = mix64(out ^ sig[:, r::rows][:, :bands].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
    return out.view(np.int64)


def own_set(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def sign(width: int, bands: int, rows: int):
    """For mapInArrow over (doc_id, text): the size and 128-bit hash of each document's set and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = shingles(part.column("text").to_pylist(), known, width)
                ends = np.cumsum(counts)
                size, digest = np.zeros(len(counts), dtype=np.int64), np.zeros((len(counts), 2), dtype=np.int64)
                for i in np.flatnonzero(counts):
                    s = own_set(h[ends[i] - counts[i] : ends[i]])
                    size[i], digest[i] = len(s), np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                made = band_hashes(signatures(h, counts, bands * rows), rows)
                offsets = np.r_[0, np.cumsum(np.where(counts > 0, bands, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.ravel()))], names=SIGNED.names)

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets shares, from the elements that occur at least twice."""
    n = len(sets)
    kind = np.float32 if max(map(len, sets), default=0) < 1 << 24 else np.float64  # the counts stay exact
    out = np.zeros((n, n), dtype=kind)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=int)
    held = np.diff(np.r_[first, len(values)])
    flat = out.reshape(-1)
    for d in np.unique(held[held >= 2]):
        at = first[held == d]
        if d <= 6:  # few owners: count the pairs themselves
            who = owner[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    flat += np.bincount(who[:, i] * n + who[:, j], minlength=n * n).astype(kind) if n < 256 else 0
                    if n >= 256:
                        np.add.at(flat, who[:, i] * n + who[:, j], 1)
    many = np.flatnonzero(held > 6)
    for a in range(0, len(many), 2048):  # many owners: a product of incidence matrices
        some = many[a : a + 2048]
        seen = np.zeros((n, len(some)), dtype=kind)
        seen[owner[np.concatenate([np.arange(first[c], first[c] + held[c]) for c in some])], np.repeat(np.arange(len(some)), held[some])] = 1
        out += np.triu(seen @ seen.T, 1)
    return out


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest position that it reaches by links of at least `percent` Jaccard similarity."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    shared = intersections(sets)
    near = np.zeros((n, n), dtype=bool)
    blocks = [slice(a, min(a + 256, n)) for a in range(0, n, 256)]  # so that no scratch array has n x n wide numbers
    for b in blocks:
        k = shared[b].astype(np.int64)
        near[b] = (k > 0) & (100 * k >= percent * (size[b, None] + size[None, :] - k))
    del shared
    near |= near.T
    label = np.arange(n)
    while True:
        found = np.concatenate([np.minimum(label[b], np.where(near[b], label[None, :], n).min(axis=1)) for b in blocks])
        found = found[found]
        if (found == label).all():
            return label
        label = found


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def confirm(width: int, percent: int):
    """For mapInArrow over rows sorted by task key: links (a, b), a > b, that hold each task's groups together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        key, ids, sets, seen = None, [], [], set()

        def flush() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                order = np.argsort(np.array(ids), kind="stable")
                who = np.array(ids)[order]
                to = who[linked([sets[i] for i in order], percent)]
                pairs = who != to
                if pairs.any():
                    yield pa.RecordBatch.from_arrays([pa.array(who[pairs]), pa.array(to[pairs])], names=LINKS.names)

        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = shingles(part.column("text").to_pylist(), known, width)
                ends = np.cumsum(counts)
                keys = zip(*(part.column(c).to_pylist() for c in ("g1", "g2", "g3", "g4")), strict=True)
                for i, (k, doc) in enumerate(zip(keys, part.column("doc_id").to_pylist(), strict=True)):
                    if k != key:
                        yield from flush()
                        key, ids, sets, seen = k, [], [], set()
                    own = own_set(h[ends[i] - counts[i] : ends[i]])
                    same = doc, xxhash.xxh3_128_digest(own.tobytes())
                    if same not in seen:  # rows that repeat a document
                        seen.add(same)
                        ids.append(doc)
                        sets.append(own)
        yield from flush()

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): large-star and small-star in turn, until all are stars around their least id.

    Each turn needs memory for no group: a star is a minimum and a join back. In a large star an id with most links meets its minimum in
    SALTS tasks; in a small star an id has only links to smaller ones, which the large star before has brought to a few.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs.select("a", "b") if small else pairs.select("a", "b").union(pairs.select("b", "a"))  # a > b in all pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        if small:
            return both.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("c", "m")).where("a <> b").distinct()
        dealt = least.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(dealt, (F.col("a") == F.col("c")) & (F.col("salt") == F.col("of")))
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def stars(pairs: DataFrame) -> bool:
        """Each id has one link, to an id that has none."""
        n, ids = pairs.agg(F.count("*"), F.count_distinct("a")).first()
        return n == ids and pairs.join(pairs.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi").isEmpty()

    pairs = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    done = pairs.isEmpty()
    while not done:
        before = pairs
        pairs = materialize(star(star(pairs, False), True), "links")
        free(before)
        done = stars(pairs)
    out = materialize(pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct().toDF("id", "component")), "components")
    free(pairs)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = BANDS, rows: int = ROWS, group_docs: int = GROUP_DOCS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(text.mapInArrow(lean(sign(width, bands, rows)), SIGNED), "signed")
    sets = signed.where("doc_id is not null and n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.min("n_shingles").alias("size"), F.first("bands").alias("bands"))
    sets = materialize(sets, "sets")
    # a doc_id may stand in several rows with other texts: all its sets belong to the same document
    held = sets.select("rep", "size", F.posexplode("bands").alias("band", "hash"))
    buckets = materialize(held.groupBy("band", "hash").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"), "buckets")
    # most bands are their document's alone; a sieve of those that aren't leaves few rows to join
    may, _ = sift(held, "hash", buckets.select("hash"))
    members = materialize(may.join(buckets, ["band", "hash"]).select("rep", "size", "band", "hash", "least", "n"), "members")
    free(buckets)
    hanging = components(members.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    whole = materialize(hanging.join(sets.groupBy("rep").agg(F.sum("size").alias("size")), F.col("id") == F.col("rep")).select("id", "component", "size"), "whole")
    sizes = whole.groupBy("component").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles"))
    fits = (F.col("docs") <= group_docs) & (F.col("shingles") <= group_shingles)
    none = F.lit(-1).cast("long")
    tasks = whole.join(sizes.where(fits), "component").select("id", F.col("component").alias("g1"), none.alias("g2"), none.alias("g3"), none.alias("g4"))
    large = sizes.where(~fits).select("component")
    if not large.isEmpty():
        tasks = tasks.union(block_tasks(members, whole.join(large, "component").select("id"), group_docs // 2, group_shingles // 2))
    tasks = materialize(tasks, "tasks")
    # every set of a document that is a candidate, whole texts; few documents are, and the sieve keeps the others' texts out of the shuffle
    may, _ = sift(text.where("doc_id is not null"), "doc_id", tasks.select("id"))
    bodies = may.join(tasks.hint("merge"), F.col("doc_id") == F.col("id")).select("doc_id", "text", "g1", "g2", "g3", "g4")
    keys = ["g1", "g2", "g3", "g4"]
    links = bodies.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(confirm(width, percent)), LINKS)
    # a set of thousands of copies is dealt to SALTS tasks
    copied = sets.where("rep <> last").select("set_hi", "set_lo", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "set_hi", "set_lo", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    same = dealt.join(copied, ["set_hi", "set_lo", "salt"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(same))
    free(sets, members, hanging, whole, tasks)
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def block_tasks(members: DataFrame, ids: DataFrame, docs: int, shingles_: int) -> DataFrame:
    """Tasks of the groups that are too large for one: each bucket by itself, and of a large bucket each pair of its blocks.

    Blocks are dealt by hash; their number follows from the bucket's documents and shingles, so a task holds two bounded blocks.
    Buckets with the same members are compared once.
    """
    own = members.join(ids, F.col("rep") == F.col("id"), "left_semi").select("rep", "size", "band", "hash").distinct()
    buckets = own.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.sum(F.xxhash64(F.lit(7), "rep").cast("decimal(38,0)")).alias("also"))
    buckets = buckets.groupBy("n", "s", "who", "also").agg(F.min(F.struct("band", "hash")).alias("at")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / docs), F.ceil(F.col("s") / shingles_)).cast("int")
    buckets = buckets.select("at.band", "at.hash", blocks.alias("blocks"))
    dealt = own.join(buckets, ["band", "hash"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.col("rep").alias("id"), F.col("band").cast("long").alias("g1"), F.col("hash").alias("g2"), F.least("block", "other").cast("long").alias("g3"), F.greatest("block", "other").cast("long").alias("g4"))
