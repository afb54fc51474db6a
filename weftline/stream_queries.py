"""Streams as queries: each runs over what is there now, a micro-batch at a time, and its sink is read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gen_queries as G
from .operators import constraints as C
from .registry import SQL, query, t
from .sources import sinks
from .streaming import stream


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset and all runs on one machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream's sink holds once its input is used up."""
    spark, at = rows.sparkSession, folder(rows.sparkSession)
    sink = sinks.files(f"{at}/out", "parquet", truncate=mode == "complete")
    stream.start(rows, sink, "rows", f"{at}/state", mode=mode).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out/rows")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream of its files."""
    kind = t(spark, sf_dir, "events").schema
    files = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    return files.parquet(f"{sf_dir}/events.parque[t]").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def rules() -> list[C.Rule]:
    return [C.number_range("value", 5, 100), C.enum("event_type", ["click", "view", "purchase"])]


BROKEN = {"range:value": "value < 5 OR value > 100", "enum:event_type": "event_type NOT IN ('click', 'view', 'purchase')"}


@query(" UNION ALL ".join(f"SELECT date_trunc('hour', ts) AS window_start, '{name}' AS rule, count(*) AS n FROM events WHERE {broken} GROUP BY 1" for name, broken in BROKEN.items()))
def s_windows(spark, sf_dir):
    """Violations by rule and hour, with a watermark: state is bounded by what may still come late."""
    counts = stream.violation_counts(events(spark, sf_dir), rules(), "ts", "1 hour", "31 days")
    return drained(counts, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rule", "n")


@query("SELECT event_id, CASE WHEN value < 5 THEN 5.0 WHEN value > 100 THEN 100.0 ELSE value END AS value, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'click' ELSE event_type END AS event_type, 0 AS n_violations FROM events")
def s_corrected(spark, sf_dir):
    """Each row of a stream corrected and validated."""
    return drained(stream.validated(events(spark, sf_dir), rules(), fix=True)).select("event_id", "value", "event_type", F.size("_violations").alias("n_violations"))


def indices(spark: SparkSession, n: int) -> DataFrame:
    at = folder(spark)
    spark.range(n).select(F.col("id").alias("value")).repartition(3).write.parquet(f"{at}/in")
    return spark.readStream.schema("value bigint").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


@query(SQL["g_references"])
def s_generated(spark, sf_dir):
    """Generated rows as a stream of row numbers, several micro-batches: the same rows as the batch."""
    return drained(stream.generated(G.generator(), "visits", indices(spark, G.COUNTS["visits"])))
