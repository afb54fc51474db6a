"""Sinks, readers and streams."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import constraints as C
from weftline.operators.generate import Config, Generator
from weftline.sources import sinks, text
from weftline.spec import Constraints, Field, Schema, Table
from weftline.streaming import stream

from .test_generate import key, rows


def schema():
    return Schema([Table("t", [key(), Field("note", required=True), Field("price", "float", constraints=Constraints(min=0)), Field("at", "timestamp", True), Field("geo", "geopoint", True), Field("tags", "array", True)])])


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, kind):
    df = Generator(schema(), Config({"t": 30})).frame(spark, "t")
    write = sinks.sink(kind, str(tmp_path))
    write("t", df)
    write("t", df)  # replaces
    back = sinks.read(spark, f"{tmp_path}/t", kind)
    assert back.count() == 30
    if kind in ("parquet", "orc"):
        assert rows(back.select(df.columns)) == rows(df)


def test_insert_text_and_memory(spark, tmp_path):
    df = Generator(schema(), Config({"t": 5})).frame(spark, "t")
    sinks.sink("sql", str(tmp_path))("t", df)
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/t").collect()]
    assert len(lines) == 5 and all(x.startswith("INSERT INTO t (id, note, price, at, geo, tags) VALUES (") and x.endswith(");") for x in lines)
    held: dict = {}
    sinks.sink("memory", held)("mem_t", df)
    assert spark.table("mem_t").count() == 5 and held["mem_t"].count() == 5
    sinks.sink("null")("t", df)
    with pytest.raises(ValueError, match="unsupported store"):
        sinks.sink("tape")


def test_literals(spark):
    df = spark.createDataFrame([(1, "a,\"b\"\n", None, True, "it's")], "i int, s string, n string, b boolean, q string")
    assert df.select(text.csv_line(df)).first()[0] == '1,"a,""b""\n",,true,it\'s'
    assert df.select(text.insert_literal("t", df)).first()[0] == "INSERT INTO t (i, s, n, b, q) VALUES (1, 'a,\"b\"\n', NULL, TRUE, 'it''s');"


def test_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS w_test LOCATION '{tmp_path}/db'")
    df = Generator(schema(), Config({"t": 12})).frame(spark, "t").select("id", "note")
    sinks.sink("catalog", "w_test", bucket_by=(4, "id"))("t", df)
    assert "w_test" in sinks.databases(spark) and "t" in sinks.tables(spark, "w_test")
    plan = spark.table("w_test.t").alias("a").join(spark.table("w_test.t").alias("b"), "id").hint("merge")._jdf.queryExecution().toString()
    assert spark.table("w_test.t").count() == 12 and plan
    sinks.rename(spark, "w_test.t", "w_test.u")
    sinks.clear(spark, "w_test.u")
    assert spark.table("w_test.u").count() == 0
    sinks.drop(spark, "w_test.u")
    sinks.create(spark, "w_test.v", df.schema)
    assert spark.table("w_test.v").isEmpty()
    spark.sql("DROP DATABASE w_test CASCADE")


def test_stats(spark, tmp_path):
    sinks.sink("parquet", str(tmp_path))("t", spark.range(100).repartition(4))
    r = sinks.stats(spark, f"{tmp_path}/t").first()
    assert (r["n_rows"], r["n_files"]) == (100, 4) and r["n_bytes"] > 0
    assert sinks.is_production("jdbc:x://live.db") and not sinks.is_production("jdbc:x://staging") and sinks.preview(spark.range(9)).count() == 5


def test_generated_stream_equals_batch(spark, tmp_path):
    g = Generator(schema(), Config({"t": 40}))
    spark.range(40).select(F.col("id").alias("value"), F.current_timestamp().alias("timestamp")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("value long, timestamp timestamp").parquet(f"{tmp_path}/in")
    q = stream.start(stream.generated(g, "t", source), name="w_rows", checkpoint=f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert rows(spark.table("w_rows").drop("timestamp")) == rows(g.frame(spark, "t"))


def test_rate_source_rows(spark):
    g = Generator(schema(), Config({"t": 40}))
    assert stream.generated(g, "t", stream.rows(spark, 10)).isStreaming


def test_windowed_violations(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/in")
    rule = [C.number_range("value", 0, 50)]
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = stream.start(stream.violation_counts(source, rule, "ts", "1 day", "1 day"), name="w_bad", mode="complete", checkpoint=f"{tmp_path}/cp")
    q.awaitTermination(120)
    want = C.validate(events, rule).where("size(_violations) > 0").count()
    assert spark.table("w_bad").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == want
    held = []
    q = stream.start(stream.validated(source, rule, fix=True), sink=lambda n, df: held.append(df.where("size(_violations) > 0").count()), checkpoint=f"{tmp_path}/cp2")
    q.awaitTermination(120)
    assert held == [0]
