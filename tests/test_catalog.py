"""Declared catalogues, repeatable loads into a database, secrets, orderings."""

import pytest
from pyspark.sql import functions as F

from weftline.catalog_queries import views
from weftline.functions import secrets
from weftline.operators import constraints as C
from weftline.operators import integrity, profile
from weftline.operators.generate import Config, Generator
from weftline.plans import catalog, depgraph
from weftline.sources import sinks
from weftline.spec import Constraints, Field, Relation, Schema, Table

from .test_generate import key


def test_schema_of_a_catalogue(spark):
    s = catalog.schema_of(views(spark))
    assert [t.name for t in s.tables] == ["lineitem", "nation", "orders", "refunds", "region"]
    orders, lines, nation, refunds = s.table("orders"), s.table("lineitem"), s.table("nation"), s.table("refunds")
    assert [f.name for f in lines.keys()] == ["l_orderkey", "l_linenumber"] and orders.field("o_orderkey").isSerial and orders.field("o_orderkey").default is None
    assert orders.field("o_status").constraints.enum == ["O", "F"] and (orders.field("o_total").constraints.min, orders.field("o_total").constraints.max) == (0, 999999)
    assert lines.field("l_quantity").constraints.min == 1 and lines.field("l_quantity").default == "1" and nation.field("n_name").default == "unknown" and nation.field("n_name").constraints.maxLength == 25 and nation.field("n_name").constraints.unique
    assert nation.field("n_regionkey").references == "region.r_regionkey" and refunds.field("line").group == refunds.field("order_key").group == "refunds_line"
    by = {r.id: r for r in s.relations}
    assert by["refunds_line"].fromFields == ["line", "order_key"] and by["refunds_line"].toFields == ["l_linenumber", "l_orderkey"] and by["refunds_line"].type == "one-to-one" and by["nation_region"].type == "many-to-one"
    # rows of the declared schema keep its references
    tables = Generator(s, Config({t.name: 30 for t in s.tables})).tables(spark)
    assert integrity.reference_report(tables, s.relations).agg(F.sum("n_orphans")).first()[0] == 0


def test_an_empty_catalogue(spark):
    own = views(spark)
    none = catalog.Catalog(*(getattr(own, n).limit(0) for n in catalog.VIEWS))
    assert catalog.schema_of(none).tables == [] and catalog.foreign_keys(none).count() == 0


URL = "jdbc:derby:memory:weft;create=true"


def test_loads_into_a_database_may_be_repeated(spark):
    sinks.execute(spark, URL, ['CREATE TABLE users ("id" INT PRIMARY KEY, "name" VARCHAR(99))', 'CREATE TABLE posts ("id" INT PRIMARY KEY, "user_id" INT)'])
    users = spark.range(50).selectExpr("cast(id as int) as id", "concat('u', id) as name")
    write = sinks.new_rows(URL, {"users": ["id"], "posts": ["id"]})
    read = lambda t: spark.read.format("jdbc").options(url=URL, dbtable=t).load()
    write("users", users.where("id < 30"))
    write("users", users.withColumn("name", F.lit("other")).union(users.limit(3)))
    assert read("users").count() == 50 and read("users").where("name = 'other'").count() == 20
    write("posts", spark.range(10).selectExpr("cast(id as int) as id", "cast(id as int) as user_id"))
    made = sinks.foreign_key_statements([Relation("posts", "users", fromField='"user_id"', toField='"id"')])
    sinks.execute(spark, URL, [made[0].replace('fk_posts_"user_id"', "fk_posts_user")])
    with pytest.raises(Exception, match="fk_posts_user|FK_POSTS_USER"):
        sinks.execute(spark, URL, ["INSERT INTO posts VALUES (99, 999)"])
    with pytest.raises(Exception):
        sinks.execute(spark, URL, ["DELETE FROM posts", "SELECT nonsense"])
    assert read("posts").count() == 10  # rolled back
    sinks.jdbc("jdbc:derby:memory:weft", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")("plain", users)
    assert read("plain").count() == 50


def test_secrets(spark):
    made = secrets.encrypt(spark, "pässword", "key")
    assert made != secrets.encrypt(spark, "pässword", "key") and [len(x) for x in made.split(":")] == [32, 32, 18] and secrets.decrypt(spark, made, "key") == "pässword"
    with pytest.raises(Exception):
        secrets.decrypt(spark, made, "other")
    df = spark.createDataFrame([("a",), (None,)], "x string").withColumn("y", secrets.encrypted(F.col("x"), "k"))
    assert sorted(map(str, (tuple(r) for r in df.select("x", secrets.decrypted(F.col("y"), "k")).collect()))) == ["('a', 'a')", "(None, None)"]


def test_orderings():
    ref = lambda n, t, required=True: Field(n, "integer", required, foreignKey=True, references=t)
    s = Schema([Table("c", [key(), ref("b_id", "b")]), Table("b", [key(), ref("a_id", "a")]), Table("a", [key(), ref("c_id", "c", False), ref("a_id", "a", False)])])
    assert depgraph.catalog_order(s) == (["a", "b", "c"], {"a"}) and depgraph.order_for("postgresql", s) == ["a", "b", "c"] and depgraph.order_for("null", s) == ["c", "b", "a"]
    rel = Schema([Table("x", [key(), Field("y_id", "integer", True)]), Table("y", [key()])], [Relation("x", "y", fromField="y_id", toField="id")])
    assert depgraph.order_for("mysql", rel) == ["y", "x"] == depgraph.order_for("unknown", rel)


def test_a_column_cycle_loses_one_edge():
    f = lambda n, **c: Field(n, "integer", constraints=Constraints(**c))
    order = depgraph.column_order(Table("t", [f("a", gtColumn="b"), f("b", gtColumn="c"), f("c", gtColumn="a"), f("d", minColumn="c")]))
    assert order.index("c") < order.index("b") < order.index("a") and order.index("c") < order.index("d")


def test_reports_of_a_table(spark):
    table = Table("t", [Field("a", "integer", True, primaryKey=True, keyIndex=0), Field("b", "integer", True, primaryKey=True, keyIndex=1), Field("mail", constraints=Constraints(unique=True)), Field("x", "integer", constraints=Constraints(nullPercentage=10, mutuallyExclusive=["y", "gone"])), Field("y", "integer")])
    df = spark.createDataFrame([(1, 1, "m", 1, None), (1, 1, "m", None, 2), (1, 2, None, None, 3), (2, None, "n", 4, 4)], "a int, b int, mail string, x int, y int")
    got = {r["rule"]: r["violations"] for r in C.table_report(df, table).collect()}
    assert got["unique:mail"] == 3 and got["unique:a+b"] == 3 and got["unique_set:mail"] == 1 and got["exclusive:x"] == 1 and got["required:b"] == 1 and got["null_rate:x"] == 0
    assert {r["rule"]: r["violations"] for r in C.table_report(df.unionByName(df.withColumn("x", F.lit(None).cast("int"))), table).collect()}["null_rate:x"] == 1
    assert C.table_report(df.limit(0), table).where("violations > 0").isEmpty()


def test_references_of_many_kinds(spark):
    child = spark.createDataFrame([(1, "x", 1, "p"), (1, "x", 2, "q"), (9, "z", 1, None), (None, None, None, "p")], "n int, s string, a int, b string")
    parent = spark.createDataFrame([(1, "x", 1, "p"), (2, "y", 2, "q"), (1, "x", 1, "p")], "id bigint, code string, a bigint, b string")
    rel = [Relation("c", "p", fromField="n", toField="id"), Relation("c", "p", fromField="s", toField="code"), Relation("c", "p", fromFields=["a", "b"], toFields=["a", "b"]), Relation("e", "p", fromField="n", toField="id")]
    got = [tuple(r) for r in integrity.reference_report({"c": child, "p": parent, "e": child.limit(0)}, rel).orderBy("relation").collect()]
    assert got == [("c.a+b", "p", 4, 2, 0), ("c.n", "p", 4, 1, 1), ("c.s", "p", 4, 1, 1), ("e.n", "p", 0, 0, 0)]


def test_pace_of_a_load(spark):
    s = Schema([Table("a", [key()]), Table("b", [key(), Field("a_id", "integer", True, references="a", foreignKey=True)])])
    seen = []
    got = Generator(s, Config({"a": 100, "b": 50}, on_progress=lambda name, rows: seen.append((name, rows)))).write(spark, sinks.nothing())
    assert seen == [("a", 100), ("b", 50)] and got[-1]["total_rows"] == 150 and got[-1]["seconds_left"] == 0 and all(r["rows_per_sec"] > 0 and r["seconds"] > 0 for r in got)


def test_array_items(spark):
    rows = [('{"_id": 1, "m": [1, {"a": 2}], "o": [{"a": 1}], "p": [1, "x", null]}',), ('{"_id": 2, "e": []}',), ("no json",), (None,)]
    table = profile.infer_table(spark.createDataFrame(rows, "j string"), "j", "t")
    assert {f.name: f.arrayItemType for f in table.fields} == {"_id": None, "e": "primitive", "m": "mixed", "o": "object", "p": "primitive"}


def test_zipf_tail_joins_the_exact_ranks(spark):
    from weftline.functions import draws

    n, s = 60_000, 1.1
    weights, total, upto = [k**-s for k in range(1, n + 1)], 0.0, []
    for w in weights:
        total += w
        upto.append(total)
    picks = [0.0, 0.3, 0.9, 0.97, 0.99, 0.9999, 1.0 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in picks], "u double").select(draws.zipf(F.col("u"), n, s)).collect()]
    for u, k in zip(picks, got, strict=True):
        want = next(i for i, x in enumerate(upto, 1) if x >= u * total)
        assert abs(k - want) <= max(1, want * 1e-4)


def test_tables_of_other_catalogues(spark):
    told = spark.createDataFrame([("id", "int(11)", "NO", "PRI", None, "auto_increment"), ("mail", "varchar(80)", "YES", "UNI", None, ""), ("kind", "enum('a','b')", "NO", "", "a", "")], "Field string, Type string, Null string, Key string, Default string, Extra string")
    t = catalog.from_describe("users", told)
    assert t.field("id").primaryKey and t.field("id").isSerial and t.field("mail").constraints.unique and t.field("mail").constraints.maxLength == 80 and t.field("kind").constraints.enum == ["a", "b"] and t.field("kind").default == "a"
    info = spark.createDataFrame([(0, "a", "INTEGER", 1, None, 1), (1, "b", "TEXT", 0, "'x'", 2), (2, "c", "REAL", 0, None, 0)], "cid int, name string, type string, notnull int, dflt_value string, pk int")
    refs = spark.createDataFrame([(0, 0, "p", "a", "x"), (0, 1, "p", "b", "y"), (1, 0, "q", "c", "z")], "id int, seq int, `table` string, `from` string, `to` string")
    t, rel = catalog.from_pragma("t", info, refs, [["c"]])
    assert [f.name for f in t.keys()] == ["a", "b"] and t.field("b").default == "x" and t.field("c").references == "q.z"
    assert [(r.toTable, r.type, r.fromFields) for r in rel] == [("p", "one-to-one", ["a", "b"]), ("q", "one-to-one", None)]
    spark.sql("CREATE OR REPLACE TEMP VIEW said AS SELECT 1 AS x")
    assert [f.name for f in catalog.from_spark(spark, "said").fields] == ["x"]


def test_handlers_read_what_is_stored(spark, tmp_path):
    for name, n in (("a", 3), ("b", 0)):
        spark.range(n).write.parquet(f"{tmp_path}/{name}")
    spark.range(2).write.json(f"{tmp_path}/c.json")
    own = sinks.handler(spark, "parquet", str(tmp_path))
    assert own.tables() == ["a", "b", "c"] and own.count("a") == 3 and not own.has_data("b") and [f.name for f in own.schema("a").fields] == ["id"]
    assert sinks.handler(spark, "json", str(tmp_path)).count("c") == 2
    spark.range(40).selectExpr("cast(id as int) as k").write.format("jdbc").options(url="jdbc:derby:memory:held;create=true", dbtable="nums").save()
    held = sinks.jdbc_handler(spark, "jdbc:derby:memory:held", ["nums"], key={"nums": ("k", 0, 40, 4)})
    assert held.tables() == ["nums"] and held.read("nums").rdd.getNumPartitions() == 4 and held.count("nums") == 40
    with pytest.raises(ValueError, match="unsupported"):
        sinks.handler(spark, "tape")


def test_types_of_a_document_store(spark):
    rows = [('{"r": {"path": "a/1"}, "g": {"latitude": 1.5, "longitude": 2}, "t": {"_seconds": 5, "_nanoseconds": 0}, "b": {"_bytes": "eA=="}, "o": {"x": 1}, "n": 1}',)]
    table = profile.infer_table(spark.createDataFrame(rows, "j string"), "j", "t", profile.document_type)
    assert {f.name: f.type for f in table.fields} == {"r": "reference", "g": "geopoint", "t": "timestamp", "b": "bytes", "o": "object", "n": "number"}
