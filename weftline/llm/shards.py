"""Shards of bounded bytes by extendible hashing.

A document's bucket is a prefix of its key's 60 hash bits (from MD5, so any engine can recompute it). Prefixes grow bit by bit, only
where a bucket is over the limit: the directory is the set of the shortest prefixes that fit. It is found on cells, that is on byte
totals of prefixes a few bits longer than an even deal would need, never on documents, and summed upward from there; cells that are still too large are
refined in the next round from their own documents only. Documents meet the directory by their cell, so nothing is held in the
driver and the directory may grow with the data.

Defined results: a text's size is its UTF-8 bytes, null 0. A document over the limit is a shard with what can't be told apart from
it, marked oversize: rows that repeat a doc_id have the same bits. A null doc_id takes the bits of its text. No rows: no shards.
Columns of docs that are called like one of the results are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize

BITS = 60
LIMIT = 1 << 20
#: Bits beyond an even deal in the first round, and more for each later one.
SPARE, STEP = 4, 8
#: Levels that are summed up in one go.
LEVELS = 4


def hash_bits() -> F.Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("t"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def nodes(cells: DataFrame, depth: int, least: int, limit: int) -> list[DataFrame]:
    """Written totals (shard_depth, shard_bits, shard_bytes, shard_docs) of all prefixes of `least` to `depth` bits that may fit, or whose
    parts may: upward from the cells, LEVELS levels from the totals of the one below them, until none of a level fits."""
    level = materialize(cells.select(F.lit(depth).alias("shard_depth"), F.col("cell").alias("shard_bits"), F.col("n_bytes").alias("shard_bytes"), F.col("n_docs").alias("shard_docs")), "nodes")
    out = [level]
    while depth > least:
        low = max(least, depth - LEVELS)
        up = level.withColumn("_d", F.explode(F.sequence(F.lit(low), F.lit(depth - 1)))).withColumn("_b", F.expr(f"shiftright(shard_bits, {depth} - _d)"))
        up = materialize(up.groupBy(F.col("_d").alias("shard_depth"), F.col("_b").alias("shard_bits")).agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_docs").alias("shard_docs")), "nodes")
        out.append(up)
        level, depth = up.where(F.col("shard_depth") == low), low
        if level.where(F.col("shard_bytes") <= limit).isEmpty():
            break
    return out


def leaves(parts: list[DataFrame], depth: int, least: int, limit: int) -> DataFrame:
    """The directory: cell (of `depth` bits), shard_depth, shard_bits, shard_bytes, shard_docs.

    A prefix of `least` to `depth` bits is a shard if it fits, or has all bits, and what it was split from doesn't fit. A prefix meets only
    the one above it, and a shard lists its cells by itself, so no prefix gathers them.
    """
    all_ = reduce(DataFrame.unionByName, parts)
    above = all_.where(f"shard_bytes > {limit}").select((F.col("shard_depth") + 1).alias("_d"), F.col("shard_bits").alias("_b"))
    fit = all_.where(f"shard_bytes <= {limit} or shard_depth = {depth}")
    split = fit.join(above, (F.col("shard_depth") == F.col("_d")) & (F.shiftright("shard_bits", 1) == F.col("_b")), "left").where(f"shard_depth = {least} or _d is not null")
    own = F.expr(f"sequence(shiftleft(shard_bits, {depth} - shard_depth), shiftleft(shard_bits + 1, {depth} - shard_depth) - 1)")
    return split.select(F.explode(own).alias("cell"), "shard_depth", "shard_bits", "shard_bytes", "shard_docs")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text, others) with n_bytes, shard (its bits as text), shard_depth, shard_bytes, shard_docs and oversize."""
    made = ["n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", "oversize"]
    own = docs.drop(*made).withColumns({"n_bytes": F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long"), "__w_bits": hash_bits()})
    keys = own.select("__w_bits", "n_bytes")
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total) / limit))) + SPARE) if total > limit else 1
    least, parts, rest = 0, [], None
    while True:
        cell = F.shiftright("__w_bits", BITS - depth)
        source = keys if rest is None else keys.join(rest, F.shiftright("__w_bits", BITS - least + 1) == F.col("_over"), "left_semi")
        cells = source.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))
        totals = nodes(cells, depth, least, limit)
        found = materialize(leaves(totals, depth, least, limit), "directory")
        free(*totals)
        over = (F.col("shard_bytes") > limit) & (F.col("shard_depth") == depth) & F.lit(depth < BITS) & (F.col("shard_docs") > 1)
        parts.append((depth, found.where(~over)))
        rest = found.where(over).select(F.col("cell").alias("_over"))
        if depth == BITS or rest.isEmpty():
            break
        least, depth = depth + 1, min(BITS, depth + STEP)
    out = None
    for depth, found in parts:
        named = found.select(F.col("cell").alias("__w_cell"), F.expr(f"right(lpad(bin(shard_bits), {BITS}, '0'), shard_depth)").alias("shard"), F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize"))
        part = own.join(named, F.shiftright("__w_bits", BITS - depth) == F.col("__w_cell"))
        part = part.select(*[c for c in docs.columns if c not in made], *made)
        out = part if out is None else out.unionByName(part)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """A folder for each shard."""
    shard(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)
