"""Generated rows: determinism, ranges, references, types, constraints, distributions."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import constraints as C
from weftline.operators import integrity
from weftline.operators.generate import Config, Generator
from weftline.plans.depgraph import column_order
from weftline.spec import TYPES, Constraints, Field, Relation, Schema, Table


def key(name="id", kind="integer"):
    return Field(name, kind, True, primaryKey=True)


def social() -> Schema:
    ref = lambda n, t: Field(n, "integer", foreignKey=True, references=t)
    tables = [
        Table("users", [key(), Field("username"), Field("email"), Field("is_active", "boolean"), Field("created_at", "timestamp"), Field("balance", "float")]),
        Table("profiles", [key(), ref("user_id", "users"), Field("description"), Field("avatar_url")]),
        Table("settings", [key(), ref("user_id", "users"), Field("theme"), Field("notifications_enabled", "boolean")]),
        Table("posts", [key(), Field("title"), Field("body"), ref("user_id", "users"), Field("status"), Field("views", "integer"), Field("published_at", "timestamp")]),
        Table("comments", [key(), ref("post_id", "posts"), ref("user_id", "users"), Field("content"), Field("created_at", "timestamp")]),
        Table("tags", [key(), Field("name")]),
        Table("post_tags", [ref("post_id", "posts"), ref("tag_id", "tags")]),
    ]
    relations = [Relation("profiles", "users", "one-to-one", "user_id", "id"), Relation("settings", "users", "one-to-one", "user_id", "id"), Relation("posts", "users", fromField="user_id", toField="id"), Relation("comments", "posts", fromField="post_id", toField="id"), Relation("comments", "users", fromField="user_id", toField="id"), Relation("post_tags", "posts", fromField="post_id", toField="id"), Relation("post_tags", "tags", fromField="tag_id", toField="id")]
    return Schema(tables, relations)


COUNTS = {"users": 20, "profiles": 20, "settings": 20, "posts": 100, "comments": 300, "tags": 25, "post_tags": 150}


def test_social_fixture(spark):
    g = Generator(social(), Config(COUNTS))
    tables = g.tables(spark)
    assert {n: df.count() for n, df in tables.items()} == COUNTS and sum(COUNTS.values()) == 635
    assert list(tables).index("users") < list(tables).index("posts") < list(tables).index("comments")
    report = integrity.reference_report(tables, g.relations)
    assert report.agg(F.sum("n_orphans")).first()[0] == 0
    assert tables["comments"].where("user_id is null or post_id is null").isEmpty()


def every_type() -> Schema:
    fields = [key(), *[Field(f"f_{t}", t) for t in TYPES], Field("r_flag", "boolean", True), Field("r_day", "date", True), Field("kind", "string", True, constraints=Constraints(enum=["a", "b"])), Field("list", "array", arrayItemType="integer"), Field("part", "object", objectFields=[Field("x", "integer"), Field("name", "string")])]
    return Schema([Table("all", fields)])


def rows(df):
    return sorted(map(str, df.collect()))


def test_output_does_not_depend_on_partitions_or_ranges(spark):
    whole = rows(Generator(every_type(), Config({"all": 100}, partitions=1)).frame(spark, "all"))
    for parts in (2, 8, 64):
        assert rows(Generator(every_type(), Config({"all": 100}, partitions=parts)).frame(spark, "all")) == whole
    g = Generator(every_type(), Config({"all": 100}))
    assert sorted(rows(g.frame(spark, "all", 50, 50)) + rows(g.frame(spark, "all", 0, 50))) == whole
    assert [r["id"] for r in g.frame(spark, "all", 10, 10).select("id").collect()] == list(range(11, 21))


def test_seeds(spark):
    one = lambda seed: rows(Generator(social(), Config({"users": 50}, seed)).frame(spark, "users"))
    assert one(123) == one(123) != one(456)


def test_required_and_null_shares(spark):
    df = Generator(every_type(), Config({"all": 4000})).frame(spark, "all")
    r = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("id", "r_flag", "r_day", "kind", "f_string", "f_integer")]).first()
    assert r["id"] == r["r_flag"] == r["r_day"] == r["kind"] == 0
    assert all(abs(r[c] - 0.2) < 0.03 for c in ("f_string", "f_integer"))
    shares = {x["kind"]: x["count"] for x in df.groupBy("kind").count().collect()}
    assert abs(shares["a"] / 4000 - 0.5) < 0.05


def test_composite_key(spark):
    parent = Table("parent", [Field("tenant_id", "integer", True, primaryKey=True, keyIndex=0), Field("user_id", "integer", True, primaryKey=True, keyIndex=1), Field("display_name")])
    child = Table("child", [key(), Field("parent_tenant_id", "integer", group="parent_ref"), Field("parent_user_id", "integer", group="parent_ref"), Field("comment")])
    rel = Relation("child", "parent", fromFields=["parent_tenant_id", "parent_user_id"], toFields=["tenant_id", "user_id"])
    g = Generator(Schema([parent, child], [rel]), Config({"parent": 10, "child": 20}, "a text"))
    t = g.tables(spark)
    assert t["parent"].count() + t["child"].count() == 30
    assert integrity.orphans(t["child"], t["parent"], rel.fromFields, rel.toFields).isEmpty()


@pytest.mark.parametrize("kind", ["integer", "long", "uuid", "objectid", "string", "number", "decimal"])
def test_keys_and_references_of_any_type(spark, kind):
    s = Schema([Table("a", [key(kind=kind)]), Table("b", [key(), Field("a_id", kind, references="a")]), Table("c", [Field("b_id", "integer", True, primaryKey=True, references="b"), Field("x")]), Table("d", [Field("c_id", "integer", references="c.b_id")])])
    t = Generator(s, Config({"a": 7, "b": 30, "c": 30, "d": 40})).tables(spark)
    for child, parent, f, k in (("b", "a", "a_id", "id"), ("c", "b", "b_id", "id"), ("d", "c", "c_id", "b_id")):
        assert integrity.orphans(t[child], t[parent], [f], [k]).isEmpty()
        assert t[child].where(F.col(f).isNull()).isEmpty()
    assert t["a"].distinct().count() == 7


def test_missing_pieces(spark):
    s = Schema([Table("users", [key()]), Table("posts", [key()]), Table("loose", [Field("name")]), Table("kid", [key()])], [Relation("posts", "users", fromField="userId"), Relation("kid", "loose")])
    g = Generator(s, Config({"users": 2, "posts": 4, "loose": 3, "kid": 6}))
    assert {r[0] for r in g.frame(spark, "posts").select("userId").collect()} == {1, 2}
    assert "No primary key found" in g.warnings[0] and "looseId" in g.frame(spark, "kid").columns

    def failing(name, df):
        if name == "posts":
            raise RuntimeError("disk full")

    results = {r["table"]: r["error"] for r in g.write(spark, failing)}
    assert results["posts"] == "disk full" and results["users"] is None


def bounded(a: str, b: str, kind: str, **limits) -> Schema:
    return Schema([Table("t", [key(), Field(b, kind, True, constraints=Constraints(min=1, max=50) if kind == "integer" else Constraints()), Field(a, kind, True, constraints=Constraints(**limits))])])


@pytest.mark.parametrize("a, b, kind, limits, op", [
    ("updated_at", "created_at", "timestamp", {"gtColumn": "created_at"}, "gt"), ("end_date", "start_date", "timestamp", {"gtColumn": "start_date"}, "gt"), ("discount_price", "original_price", "number", {"ltColumn": "original_price"}, "lt"),
    ("quantity_available", "total_quantity", "integer", {"ltColumn": "total_quantity"}, "lt"), ("high", "low", "integer", {"minColumn": "low"}, "gte"), ("low", "high", "number", {"maxColumn": "high"}, "lte"),
])
def test_cross_column_bounds_hold(spark, a, b, kind, limits, op):
    s = bounded(a, b, kind, **limits)
    assert column_order(s.tables[0]).index(b) < column_order(s.tables[0]).index(a)
    df = Generator(s, Config({"t": 500})).frame(spark, "t")
    assert C.report(df, C.from_table(s.tables[0])).where("violations > 0").isEmpty(), C.report(df, [C.compare(a, op, b)]).collect()


def test_cyclic_bounds_do_not_raise(spark):
    s = Schema([Table("t", [key(), Field("a", "integer", constraints=Constraints(gtColumn="b")), Field("b", "integer", constraints=Constraints(gtColumn="a"))])])
    assert Generator(s, Config({"t": 5})).frame(spark, "t").count() == 5


def test_generated_rows_keep_their_own_rules(spark):
    fields = [key(), Field("code", "string", True, constraints=Constraints(minLength=8, maxLength=20, unique=True)), Field("email", "string", True, constraints=Constraints(unique=True, lowercase=True)), Field("age", "integer", True, constraints=Constraints(min=18, max=65)), Field("score", "float", constraints=Constraints(min=0, max=0)), Field("step", "integer", constraints=Constraints(min=0, max=100, multipleOf=5)), Field("tags", "set", arrayItemType="string", constraints=Constraints(minItems=2, maxItems=4)), Field("at", "timestamp", constraints=Constraints(startDate="2020-01-01", endDate="2020-12-31"))]
    t = Table("t", fields)
    df = Generator(Schema([t]), Config({"t": 1000})).frame(spark, "t")
    assert C.report(df, C.from_table(t)).where("violations > 0").collect() == []
    for c in ("code", "email", "id"):
        assert integrity.duplicates(df, [c]).isEmpty()
    assert df.where("email not rlike '^[^@ ]+_[0-9]+@[^@ ]+$'").isEmpty()


def test_many_to_many(spark):
    s = Schema([Table("posts", [key(), Field("tag_ids", "array", arrayItemType="integer")]), Table("tags", [key()])], [Relation("posts", "tags", "many-to-many", "tag_ids", minReferences=1, maxReferences=3)])
    t = Generator(s, Config({"posts": 200, "tags": 9})).tables(spark)
    ids = t["posts"].select(F.explode("tag_ids").alias("tag_id"))
    assert integrity.orphans(ids, t["tags"], ["tag_id"], ["id"]).isEmpty()
    assert t["posts"].where("size(tag_ids) not between 1 and 3 or size(array_distinct(tag_ids)) <> size(tag_ids)").isEmpty()


def test_realism(spark):
    s = Schema([Table("posts", [key(), Field("title", required=True), Field("views", "integer", True)]), Table("users_india", [key(), Field("full_name", required=True), Field("job_title", required=True), Field("aadhaar", required=True)])])
    t = Generator(s, Config({"posts": 10, "users_india": 200}, 12345)).tables(spark)
    assert t["users_india"].where("aadhaar not rlike '^[0-9]{4} [0-9]{4} [0-9]{4}$' or job_title = ''").isEmpty()
    assert {"Sharma", "Patel"} <= {r[0].split()[1] for r in t["users_india"].select("full_name").collect()}


def test_distributions(spark):
    s = Schema([Table("t", [key(), Field("n", "float", True), Field("z", "integer", True), Field("e", "float", True)])])
    cfg = Config({"t": 20000}, distributions={"t.n": {"kind": "normal", "mean": 10, "sd": 2}, "t.z": {"kind": "zipf", "n": 100, "s": 1.2}, "t.e": {"kind": "exponential", "rate": 0.5}})
    r = Generator(s, cfg).frame(spark, "t").agg(F.avg("n"), F.stddev("n"), F.avg((F.col("z") == 1).cast("int")), F.max("z"), F.avg("e")).first()
    head = 1 / sum(1 / k**1.2 for k in range(1, 101))
    assert abs(r[0] - 10) < 0.1 and abs(r[1] - 2) < 0.1 and abs(r[2] - head) < 0.02 and r[3] <= 100 and abs(r[4] - 2) < 0.1
