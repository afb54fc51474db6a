"""The same expressions over unbounded rows: generated streams, validated streams, windowed counts of violations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import constraints as C
from ..operators.generate import Generator


def rows(spark: SparkSession, per_second: int = 100, partitions: int = 1) -> DataFrame:
    """An unbounded source of row indices and times."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", partitions).load()


def generated(generator: Generator, table: str, source: DataFrame) -> DataFrame:
    """Rows of a table for the indices in a stream's column `value`: row i is the same as in the batch of that table."""
    return generator.project(source.withColumn("_row", F.col("value")), table, tuple(c for c in ("timestamp",) if c in source.columns))


def validated(stream: DataFrame, rules: list[C.Rule], fix: bool = False) -> DataFrame:
    """Each row with its violations, after corrections if asked."""
    return C.validate(C.correct(stream, rules) if fix else stream, rules)


def violation_counts(stream: DataFrame, rules: list[C.Rule], time: str, every: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, rule and n; a row later than `late` is left out, so state stays bounded."""
    found = C.validate(stream.withWatermark(time, late), rules).where(F.size("_violations") > 0).select(time, F.explode("_violations.rule").alias("rule"))
    window = F.window(time, every, slide) if slide else F.window(time, every)
    return found.groupBy(window.alias("w"), "rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "rule", "n")


def start(stream: DataFrame, sink: Callable[[str, DataFrame], None] | None = None, name: str = "stream", checkpoint: str | None = None, once: bool = True, mode: str = "append", **options) -> StreamingQuery:
    """Runs a stream into a sink of sources.sinks, a micro-batch at a time, or into memory; resumes from its checkpoint."""
    out = stream.writeStream.outputMode(mode).options(**options)
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if once else out
    return (out.foreachBatch(lambda df, _: sink(name, df)) if sink else out.format("memory").queryName(name)).start()
