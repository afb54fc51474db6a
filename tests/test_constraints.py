"""Rules on single rows, on tables, and across tables."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import browse, constraints as C, discover, integrity, profile
from weftline.spec import Constraints, Field, Relation, Table


def broken(spark, rule, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return C.validate(df, [rule]).selectExpr("size(_violations) > 0").first()[0]


RULES = lambda: [  # noqa: E731  columns need a session
    (C.number_range("x", 0, 10), {"x": 5}, False), (C.number_range("x", 0, 10), {"x": 11}, True), (C.number_range("x", 0, 10), {"x": "abc"}, True), (C.number_range("x", 0, 10), {"x": None}, False), (C.number_range("x", 0, 10, True), {"x": 10}, True),
    (C.length("x", 2, 3), {"x": "a"}, True), (C.length("x", 2, 3), {"x": "abc"}, False), (C.pattern("x", "b+"), {"x": "abbc"}, False), (C.pattern("x", "^b"), {"x": "ab"}, True),
    (C.enum("x", ["a", "b"]), {"x": "c"}, True), (C.enum("x", ["a", "b"]), {"x": None}, False), (C.email("x"), {"x": "a@b.c"}, False), (C.email("x"), {"x": "a@b"}, True), (C.url("x"), {"x": "HTTPS://a.b/c"}, False), (C.url("x"), {"x": "ftp://a"}, True),
    (C.compare("x", "lt", "y"), {"x": 1, "y": 2}, False), (C.compare("x", "gt", "y"), {"x": 1, "y": 2}, True), (C.compare("x", "eq", "y"), {"x": None, "y": 2}, False),
    (C.sum_of("x", ["y", "z"]), {"x": 110, "y": 100, "z": 10}, False), (C.sum_of("x", ["y", "z"]), {"x": 111, "y": 100, "z": 10}, True), (C.sum_of("x", ["y", "z"]), {"x": 100, "y": 100, "z": None}, False),
    (C.ratio_of("x", "y", "z"), {"x": 0.5, "y": 1, "z": 2}, False), (C.ratio_of("x", "y", "z"), {"x": 0.5, "y": 1, "z": 0}, True), (C.percentage_of("x", "y", "z"), {"x": 50.5, "y": 1, "z": 2}, False), (C.percentage_of("x", "y", "z"), {"x": 52.0, "y": 1, "z": 2}, True),
    (C.mutually_exclusive("x", ["y"]), {"x": 1, "y": 2}, True), (C.mutually_exclusive("x", ["y"]), {"x": 1, "y": None}, False),
    (C.temporal("x", "before", "2023-12-31"), {"x": "2023-01-01"}, False), (C.temporal("x", "after", "2023-12-31"), {"x": "2023-01-01"}, True), (C.temporal("x", "within_days", "2023-01-01", 30), {"x": "2023-01-15"}, False), (C.temporal("x", "within_days", "2023-01-01", 30), {"x": "2023-02-15"}, True),
    (C.temporal("x", "older_than", "2024-01-01", 18), {"x": "2004-01-01"}, False), (C.temporal("x", "older_than", "2024-01-01", 18), {"x": "2014-01-01"}, True), (C.temporal("x", "before", "2023-12-31"), {"x": "no time"}, True), (C.temporal("x", "before", "2023-12-31"), {"x": None}, False),
]


def test_rules(spark):
    for rule, values, want in RULES():
        assert broken(spark, rule, **values) is want, (rule.name, values)


def test_approval(spark):
    rule = C.conditional("approved_at", C.condition("status", "eq", "approved"), C.condition("approved_at", "exists"), C.condition("approved_at", "not_exists"))
    assert not broken(spark, rule, status="approved", approved_at="2024-01-01") and broken(spark, rule, status="approved", approved_at=None)
    assert broken(spark, rule, status="draft", approved_at="2024-01-01") and not broken(spark, rule, status="draft", approved_at=None)


def test_order_document(spark):
    rules = [C.number_range("price", 0, 100), C.number_range("quantity", 1)]
    df = spark.createDataFrame([(200.0, -5), (50.0, 2)], "price double, quantity int")
    assert {r["rule"]: r["violations"] for r in C.report(df, rules).collect()} == {"range:price": 1, "range:quantity": 1, "*": 1}
    assert [tuple(r) for r in C.correct(df, rules).collect()] == [(100.0, 1), (50.0, 2)]
    assert C.report(C.correct(df, rules), rules).where("violations > 0").isEmpty()


def test_registry(spark):
    reg = C.Registry().register(C.number_range("x", 0, 1), C.enum("y", ["a"]))
    other = reg.clone()
    assert reg.unregister("enum:y") and not reg.unregister("enum:y") and "enum:y" in other and other.stats()["rules"] == 2
    df = spark.createDataFrame([(5, "b"), (1, "a")], "x int, y string")
    other.mode = "skip"
    assert other.apply(df).count() == 1
    other.mode = "strict"
    with pytest.raises(ValueError, match="range:x"):
        other.apply(df)
    other.mode = "retry"
    assert [tuple(r) for r in other.apply(df).collect()] == [(1, "a"), (1, "a")]
    other.clear()
    assert not other.rules and C.validate(df, []).selectExpr("sum(size(_violations))").first()[0] == 0


def test_rules_of_a_table():
    t = Table("t", [Field("a", "integer", True, constraints=Constraints(min=0, gtColumn="b", multipleOf=2)), Field("b", "integer", constraints=Constraints(max=0)), Field("c", constraints=Constraints(minLength=1, pattern="x", enum=["x"]))])
    assert [r.name for r in C.from_table(t)] == ["required:a", "range:a", "multipleOf:a", "gt:a", "range:b", "length:c", "pattern:c", "enum:c"]


def test_integrity_with_nulls_and_empty_tables(spark):
    child = spark.createDataFrame([(1,), (None,), (9,), (9,)], "p int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    r = integrity.reference_report({"c": child, "p": parent, "e": parent.limit(0)}, [Relation("c", "p", fromField="p", toField="id"), Relation("c", "e", fromField="p", toField="id"), Relation("e", "p", fromField="id", toField="id")]).collect()
    assert [tuple(x)[2:] for x in r] == [(4, 1, 2), (4, 1, 3), (0, 0, 0)]
    assert integrity.uniqueness(child, ["p"]).first().asDict() == {"n_rows": 3, "n_values": 2, "n_repeated": 1, "n_violating": 2}
    assert integrity.cross_table(parent.distinct(), "id", child, "p", "count", F.lit(1), "value > 0").count() == 1


def test_browse(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else None) for k in range(20)], "id int, x string")
    assert [r[0] for r in browse.browse(df, {"x": "a"}, 2, 3, ["id"]).select("id").collect()] == [5, 7, 9]
    assert browse.delete(df, {"x": "a"}).count() == 10 and browse.update(df, {"id": 3}, {}).count() == 20
    assert browse.update(df, {"id": 2}, {"x": "new"}).where("x = 'new'").count() == 1
    assert browse.exists(df, "id", 4) and not browse.exists(df, "id", 40) and browse.next_key(df, "id").first()[0] == 20
    assert browse.has_data(df) and not browse.has_data(df.limit(0))


def test_json_profile(spark):
    rows = [('{"_id": "x", "a": 1, "b": null}',), ('{"_id": "y", "a": "t", "c": [1]}',), ('{"_id": "z", "a": 2.5, "b": true, "d": {"e": 1}}',), ("not json",), (None,), ("[1]",)]
    df = spark.createDataFrame(rows, "doc string")
    found = {(r["key"], r["type"]): (r["n"], r["dominant"]) for r in profile.type_histogram(df, "doc").collect()}
    assert found["a", "number"] == (2, True) and found["a", "string"] == (1, False) and found["b", "boolean"] == (1, True) and found["c", "array"] == (1, True) and found["d", "object"] == (1, True)
    t = profile.infer_table(df.limit(3), "doc", "t")
    assert [f.name for f in t.fields] == ["_id", "a", "b", "c", "d"] and t.field("a").type == "number" and t.field("a").required and not t.field("b").required
    assert profile.infer_table(df.limit(0), "doc", "t").fields[0].type == "objectid"


def test_discovery(spark):
    users = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "id int, name string")
    posts = spark.createDataFrame([(k, k % 50, [k % 50], k + 1000) for k in range(200)], "id int, user_id int, user_ids array<int>, views int")
    found = {(r["childTable"], r["column"]): r for r in discover.discover({"users": users, "posts": posts}, {"users": "id", "posts": "id"}).collect()}
    assert found["posts", "user_id"]["type"] == "1:N" and found["posts", "user_ids"]["type"] == "N:M" and ("posts", "views") not in found
    assert abs(found["posts", "user_id"]["confidence"] - 1.0) < 1e-9 and found["posts", "user_id"]["coverage"] == 1.0
    names = discover.by_names({"users": users.schema, "posts": posts.schema}, {"users": "id", "posts": "id"})
    assert [(n["childTable"], n["column"], n["confidence"]) for n in names] == [("posts", "user_id", 0.75)]
    none = discover.discover({"users": users.limit(0), "posts": posts}, {"users": "id"})
    assert none.isEmpty()


def test_sample_sizes(spark):
    df = spark.createDataFrame([(5,), (999,), (1000,), (50_000,), (100_000,), (5_000_000,)], "n bigint")
    assert [r[0] for r in df.select(profile.sample_size(F.col("n"))).collect()] == [5, 999, 100, 500, 1000, 5000]
