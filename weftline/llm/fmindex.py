"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmarks' windows.

A shard is what one task reads, cut at a bound of words. Its words become numbers of the benchmark's vocabulary; a word outside it
can be in no occurrence, so each stretch of such words is one separator, and stretches between separators that are shorter than the
shortest window are left out. Over that sequence stand a suffix array, its Burrows-Wheeler transform in a wavelet matrix, and every
`SAMPLE`-th suffix position. Backward search narrows a range of suffixes word by word for many windows at once, those whose range gets
empty being dropped; each row of the final ranges walks back to a sampled position, which locates the occurrence; overlapping
occurrences are merged into removal spans.

Memory: the workers hash the benchmark's words and write them once, long items in parts that overlap. The driver reads them one after
another and sends them to the workers in chunks of `CHUNK_WORDS` words, a part at most over it; neither it nor a worker ever holds more
than one chunk. With several chunks the rows are numbered and written once, each chunk but the last is a pass of its own that writes
what it finds, and the last pass joins all that; only rows with finds are shuffled.

Defined results: a null or empty text has no words; a null or wordless item has no windows; rows that repeat an item_id are one item
with the windows of all; items without an id are left out; rows of documents are treated one by one, whatever their ids.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, lean, materialize, sift, slices

#: Words of the text that make a shard, before those outside the vocabulary go.
SHARD_WORDS = 500_000
#: Every so many places of the sequence the suffix array is kept.
SAMPLE = 8
#: Words of benchmark items searched in one pass, and windows searched at a time.
CHUNK_WORDS, BLOCK = 2_000_000, 100_000
WINDOW = 8
#: Distinct words whose numbers a worker remembers, and words of a vocabulary that is kept as a table.
CACHE, TABLE = 500_000, 300_000


class WaveletMatrix:
    """Ranks of any symbol before any place: one bit vector a level, most significant bit first, with block counts."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before place[i]."""
        low, high = np.zeros_like(place), place
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return high - low


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling. Separators (0) each count as a letter of its own, so that no comparison goes beyond one."""
    n = len(seq)
    cut = seq == 0
    rank = np.where(cut, np.cumsum(cut) - 1, seq.astype(np.int64) + cut.sum())
    h, order = 1, np.argsort(rank, kind="stable")
    sorted_ = rank[order]
    fresh = np.r_[True, sorted_[1:] != sorted_[:-1]]
    while not fresh.all():
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        # only suffixes that still share their rank are sorted again
        open_ = ~(fresh & np.r_[fresh[1:], True])
        at = np.flatnonzero(open_)
        who = order[at]
        tail = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = rank[who] * (n + 2) + tail
        by = np.argsort(key, kind="stable")
        order[at] = who[by]
        key = key[by]
        fresh[at] = np.r_[True, key[1:] != key[:-1]]
        h *= 2
    return order


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        """seq: symbols below sigma, 0 for separators; it starts and ends with a separator."""
        self.n = len(seq)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]  # of the first suffix: the last symbol, a separator
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=sigma))].astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        kept = (sa % SAMPLE == 0) | (self.bwt == 0)  # a walk back never has to cross a separator
        self.kept, self.at = kept, sa[kept]
        self.kept_before = np.r_[0, np.cumsum(kept)]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one in a row. The range of suffixes that start with each."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        left = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[left, k]
            low[left], high[left] = self.before[c] + self.wavelet.rank(c, low[left]), self.before[c] + self.wavelet.rank(c, high[left])
            left = left[high[left] > low[left]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps, rows, out = np.zeros(len(rows), dtype=np.int64), rows.copy(), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = rows[left]
            done = self.kept[r]
            out[left[done]] = self.at[self.kept_before[r[done]]] + steps[left[done]]
            left, r = left[~done], r[~done]
            c = self.bwt[r]
            rows[left] = self.before[c] + self.wavelet.rank(c, r)
            steps[left] += 1
        return out


hashed = xxhash.xxh3_64_intdigest


@dataclass
class Chunk:
    """Windows to search for. vocabulary: sorted 64-bit hashes of their words; words: numbers of the words (from 1) of all parts of items,
    one after another; at, length: a distinct window each; owners[first[w]:first[w + 1]]: the items (places in ids) of window w. spelled: the
    words of a small vocabulary themselves, in its order."""

    vocabulary: np.ndarray
    words: np.ndarray
    at: np.ndarray
    length: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    ids: list[str]
    spelled: list[bytes] | None

    @classmethod
    def of(cls, parts: list[tuple[str, np.ndarray]], width: int, spelled: set[bytes] | None = None) -> Chunk:
        """parts: an item's id and hashes of words one after another. spelled: all their words."""
        ids = sorted({i for i, _ in parts})
        number = {x: k for k, x in enumerate(ids)}
        words = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, dtype=np.uint64)
        sizes = np.array([len(w) for _, w in parts], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        length = np.minimum(sizes, width)
        counts = sizes - length + 1
        at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        own, length = np.repeat(np.array([number[i] for i, _ in parts], dtype=np.int32), counts), np.repeat(length, counts)
        key = length.astype(np.uint64)
        for k in range(width):
            key = np.where(length > k, mixed(key ^ words[np.minimum(at + k, len(words) - 1)]), key) if len(at) else key
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
        other = fresh | np.r_[True, own[1:] != own[:-1]] if len(key) else fresh
        first = np.r_[np.flatnonzero(fresh[other]), other.sum()]
        vocabulary, symbols = np.unique(words, return_inverse=True)
        pick = order[fresh]
        return cls(vocabulary, (symbols + 1).astype(np.int32), at[pick].astype(np.int32), length[pick].astype(np.int8), first.astype(np.int32), own[other], ids, None if spelled is None else sorted(spelled, key=hashed))

    def plain(self) -> tuple:
        """What a broadcast carries: a worker may not know this class."""
        return self.vocabulary, self.words, self.at, self.length, self.first, self.owners, self.ids, self.spelled

    @property
    def shortest(self) -> int:
        return int(self.length.min(initial=127)) if len(self.length) else 0


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Numbers(dict):
    """word -> its number in a large vocabulary, 0 outside, by bisection."""

    def __init__(self, vocabulary: np.ndarray):
        self.sorted = array("Q", vocabulary.tobytes())

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = hashed(word)
        k = bisect_left(self.sorted, h)
        value = self[word] = k + 1 if k < len(self.sorted) and self.sorted[k] == h else 0
        return value


def numbering(chunk: Chunk):
    """For words one after another their numbers: from a table where the words are spelled out."""
    if chunk.spelled is None:
        known = Numbers(chunk.vocabulary)
        return lambda words: map(known.__getitem__, words)
    table = {w: k + 1 for k, w in enumerate(chunk.spelled)}
    return lambda words: map(table.get, words, repeat(0))


def find(docs: list[list[bytes]], chunk: Chunk, numbers) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document the merged spans of word places (from, to) that are hit, and the items found. numbers: numbering() of the chunk."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    if not chunk.shortest or not lengths.sum():
        return list(zip(spans, items, strict=True))
    # each document ends with a separator; places: of each number in its document
    code = np.zeros(int(lengths.sum()) + len(docs), dtype=np.int64)
    text = np.ones(len(code), dtype=bool)
    text[np.cumsum(lengths + 1) - 1] = False
    code[text] = np.fromiter(numbers(chain.from_iterable(docs)), dtype=np.int64, count=int(lengths.sum()))
    doc = np.repeat(np.arange(len(docs)), lengths + 1)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    edge = np.flatnonzero(np.diff(np.r_[False, code > 0, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long_ = end - start >= chunk.shortest
    start, end = start[long_], end[long_]
    if len(start):
        # the stretches one after another, a separator before each and one at the end
        size = end - start + 1
        at = np.repeat(start - 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        seq = code[np.maximum(at, 0)]
        seq[np.cumsum(size) - size] = 0
        # numbers of the words that the shard has; windows with another word can't occur
        present, seq = np.unique(np.r_[seq, 0], return_inverse=True)
        local = np.zeros(len(chunk.vocabulary) + 1, dtype=np.int32)
        local[present] = np.arange(len(present))
        words = local[chunk.words]
        absent = np.r_[0, np.cumsum(words == 0, dtype=np.int32)]
        may = absent[chunk.at + chunk.length] == absent[chunk.at]
        index = FMIndex(seq.astype(np.int64), len(present))
        hits: list[tuple[np.ndarray, ...]] = []
        for n in np.unique(chunk.length[may]).tolist():
            own = np.flatnonzero(may & (chunk.length == n))
            for k in range(0, len(own), BLOCK):
                which = own[k : k + BLOCK]
                low, high = index.search(words[chunk.at[which][:, None] + np.arange(n)].astype(np.int64))
                count = high - low
                rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                where = at[index.locate(rows)]
                hits.append((doc[where], place[where], place[where] + n, np.repeat(which, count)))
        who, a, b, window = (np.concatenate(x) if hits else np.zeros(0, dtype=np.int64) for x in (list(zip(*hits, strict=True)) or [()] * 4))
        for d, w in np.unique(np.stack([who, window], axis=1), axis=0).tolist() if len(who) else ():
            items[d].update(chunk.ids[o] for o in chunk.owners[chunk.first[w] : chunk.first[w + 1]].tolist())
        order = np.lexsort((a, who))
        for d, x, y in zip(who[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True):
            own = spans[d]
            if own and x <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], y))
            else:
                own.append((x, y))
    return list(zip(spans, items, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
FOUND = (("n_words", pa.int64()), ("spans", SPAN), ("items", pa.list_(pa.string())))
FOUND_SPARK = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))]


def search(chunk, text: str, sparse: bool = False):
    """For mapInArrow: adds n_words, spans and items to each row, with those of an earlier pass if there are any; sparse: only the row
    numbers, spans and items of rows in which something is found. chunk: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = [], [], 0
        own = Chunk(*chunk.value)
        numbers = numbering(own)

        def flush() -> Iterator[pa.RecordBatch]:
            found = find(docs, own, numbers)
            rows = pa.Table.from_batches(held)
            if "__w_spans" in rows.column_names:
                before = zip(*(rows.column(c).to_pylist() for c in ("__w_spans", "__w_items")), strict=True)
                found = [(merged([*spans, *((s["first"], s["end"]) for s in old or ())]), items | set(other or ())) for (spans, items), (old, other) in zip(found, before, strict=True)]
                rows = rows.drop_columns(["__w_spans", "__w_items"])
            values = ([len(d) for d in docs], [[{"first": a, "end": b} for a, b in s] for s, _ in found], [sorted(i) for _, i in found])
            for (name, kind), v in zip(FOUND, values, strict=True):
                rows = rows.append_column(pa.field(name, kind), pa.array(v, type=kind))
            if sparse:
                rows = rows.filter(pa.array([bool(i) for _, i in found], type=pa.bool_())).select(["__w_row", "spans", "items"])
            yield from rows.combine_chunks().to_batches()

        for batch in batches:
            for part in slices(batch, text):
                held.append(part)
                new = [alnum_words(t) for t in part.column(text).to_pylist()]
                docs += new
                words += sum(map(len, new))
                if words >= SHARD_WORDS:
                    yield from flush()
                    held, docs, words = [], [], 0
        if held:
            yield from flush()

    return run


def parted(width: int, most: int):
    """For mapInArrow over (item_id, text): hashes of the item's words as bytes, and the words themselves, in parts of `most` windows that overlap by a window but a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows, spelled = [], [], []
                for i, t in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = alnum_words(t)
                    h = np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))
                    for k in range(0, max(0, len(h) - width) + 1 if len(h) else 0, most):
                        ids.append(i)
                        rows.append(h[k : k + most + width - 1].tobytes())
                        spelled.append(b" ".join(set(words[k : k + most + width - 1])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.string()), pa.array(rows, type=pa.binary()), pa.array(spelled, type=pa.binary())], names=["item_id", "words", "spelled"])

    return run


def chunked(benchmark: DataFrame, width: int, most: int) -> Iterator[Chunk]:
    """The benchmark's windows, `most` words at a time; a chunk without any if there are none."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = materialize(items.mapInArrow(lean(parted(width, most)), "item_id string, words binary, spelled binary"), "windows")
    held, words, any_, spelled = [], 0, False, set()
    for r in parts.toLocalIterator():
        held.append((r["item_id"], np.frombuffer(r["words"], dtype=np.uint64)))
        words += len(held[-1][1])
        if spelled is not None:
            spelled.update(bytes(r["spelled"]).split(b" "))
            spelled = spelled if len(spelled) <= TABLE else None
        if words >= most:
            yield Chunk.of(held, width, spelled)
            held, words, any_, spelled = [], 0, True, set()
    if held or not any_:
        yield Chunk.of(held, width, spelled)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs (any columns, with text) and n_words, spans (merged word places hit) and items (ids found)."""
    spark = docs.sparkSession
    own = docs.drop(*[n for n, _ in FOUND])
    out = T.StructType([*own.schema.fields, *FOUND_SPARK])
    rows, before = own, None
    chunks = chunked(benchmark, width, chunk_words)
    chunk = next(chunks)
    for after in chunks:  # this one isn't the last
        if before is None:
            rows = materialize(own.withColumn("__w_row", F.monotonically_increasing_id()), "rows")
        sent = spark.sparkContext.broadcast(chunk.plain())
        hits = materialize(rows.select("__w_row", "text").mapInArrow(lean(search(sent, "text", True)), T.StructType([T.StructField("__w_row", T.LongType()), *FOUND_SPARK[1:]])), "hits")
        sent.destroy()
        before, chunk = hits if before is None else before.unionByName(hits), after
    if before is not None:
        before = materialize(before.groupBy(F.col("__w_row").alias("__w_of")).agg(F.flatten(F.collect_list("spans")).alias("__w_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("__w_items")), "hits")
        may, rest = sift(rows, "__w_row", before.select("__w_of"))
        may = may.join(before.hint("merge"), F.col("__w_row") == F.col("__w_of"), "left").drop("__w_of")
        rows = may.unionByName(rest, allowMissingColumns=True).drop("__w_row")
    return rows.mapInArrow(lean(search(spark.sparkContext.broadcast(chunk.plain()), "text")), out)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def clean(found: DataFrame, columns: list[str], least_items: int = 2) -> DataFrame:
    """Leaves out the words of the removal spans of documents with at least `least_items` items; others stay as they are."""
    schema = T.StructType([found.schema[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (spans, items) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                if len(items) >= least_items:
                    texts[i] = without(texts[i], [(s["first"], s["end"]) for s in spans])
            cols = [pa.array(texts, type=batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return found.mapInArrow(lean(run), schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words first .. end - 1 of each span, their gaps included."""
    raw = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(raw.lower().translate(bytes(0 if c < 0x80 and not chr(c).isalnum() else 1 for c in range(256))), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[0, mask, 0].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : start[a]])
        last = end[b - 1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")

