import json

import pytest

from weftline import tools
from weftline.plans import codegen, depgraph, design, infer, schema_diff as sd
from weftline.sources import sinks
from weftline.spec import Constraints, Field, Relation, Schema, Table

from .test_generate import key, social


def test_levels_and_cycles():
    s = social()
    levels, cyclic = depgraph.levels(depgraph.table_graph(s))
    assert levels == [["users", "tags"], ["profiles", "settings", "posts"], ["comments", "post_tags"]] and not cyclic
    loop = Schema([Table("a", [key(), Field("b_id", "integer", True, references="b")]), Table("b", [key(), Field("a_id", "integer", references="a")])])
    assert depgraph.levels(depgraph.table_graph(loop)) == ([["b"], ["a"]], True)
    own = Schema([Table("a", [key(), Field("a_id", "integer", references="a")])])
    assert depgraph.levels(depgraph.table_graph(own)) == ([["a"]], False)


def test_recursive_levels(spark):
    found = {r["name"]: r["level"] for r in depgraph.recursive_levels(spark, depgraph.relation_edges(social().relations)).collect()}
    assert found == {"users": 0, "tags": 0, "profiles": 1, "settings": 1, "posts": 1, "comments": 2, "post_tags": 2}


@pytest.mark.parametrize("field, table, want", [
    ("email", "users", "email"), ("name", "products", "product_name"), ("name", "users", "full_name"), ("title", "movies", "movie_title"), ("order_number", "", "order_number"), ("updatedAt", "", "updated_at"),
    ("is_strange", "", "flag70"), ("zzz_count", "", "counter"), ("zzz_no", "", "count1000"), ("built_at", "", "created_at"), ("overtime", "", "created_at"), ("heartbeat", "", "created_at"), ("ghref", "", "word"), ("g_href", "", "url"), ("namely", "", "word"), ("qname", "", "full_name"), ("qwerty", "", "word"), ("views", "", "views"), ("user_uuid", "", "uuid"),
])
def test_inference(field, table, want):
    assert infer.infer(field, table) == want


def test_rules_have_generators():
    from weftline.functions import providers as P

    assert {r.generator for r in infer.RULES} - set(P.TEXT) == set()
    n = len(infer.RULES)
    infer.register_rule("city", "wonder+land", 20)
    assert infer.infer("wonder_land") == "city"
    del infer.RULES[n:]
    infer.infer.cache_clear()


@pytest.mark.parametrize("old, new, want", [
    ("smallint", "integer", False), ("integer", "bigint", False), ("real", "double precision", False), ("char(10)", "varchar(50)", False), ("varchar(10)", "text", False), ("varchar(10)", "varchar(50)", False), ("int4", "integer", False),
    ("varchar(50)", "varchar(10)", True), ("text", "integer", True), ("bigint", "integer", True), ("timestamp", "boolean", True), ("timestamp", "timestamptz", False),
])
def test_destructive(old, new, want):
    assert sd.is_destructive(old, new) is want


def test_diff_and_statements(spark):
    old = {"users": {c.name: c for c in (sd.Column("id", "integer", False), sd.Column("name", "varchar(50)"), sd.Column("gone", "text"))}, "dead": {"id": sd.Column("id", "integer")}}
    new = {"public.Users": {c.name: c for c in (sd.Column("id", "bigint", False), sd.Column("name", "varchar(10)", False, "x"), sd.Column("extra", "jsonb"))}, "fresh": {"id": sd.Column("id", "uuid", False, primaryKey=True)}}
    assert sd.diff(None, new).total == 0
    d = sd.diff(old, new)
    assert d.summary() == {"addedTables": 1, "removedTables": 0, "modifiedTables": 1, "totalChanges": 4, "destructiveChanges": 1}
    d = sd.diff(old, new, "full")
    assert (d.total, d.destructive) == (6, 3)
    sql = [s.sql for s in sd.ddl(d)]
    assert [s.kind for s in sd.ddl(d)] == ["CREATE_TABLE", "ADD_COLUMN", "ALTER_COLUMN", "ALTER_COLUMN", "ALTER_COLUMN", "ALTER_COLUMN", "DROP_COLUMN", "DROP_TABLE"]
    assert 'ALTER TABLE "users" ALTER COLUMN "id" TYPE bigint USING "id"::bigint;' in sql and 'ALTER TABLE "users" ALTER COLUMN "name" TYPE varchar(10);' in sql and 'DROP TABLE "dead" CASCADE;' in sql
    assert "CREATE TABLE `fresh` (\n  `id` STRING NOT NULL\n);" in [s.sql for s in sd.ddl(d, "spark")]
    ran = []
    assert sd.execute(sd.ddl(d), ran.append)["failedAt"].startswith('ALTER TABLE "users" ALTER COLUMN "name" TYPE') and len(ran) == 3
    frame = sd.diff_frame(sd.snapshot_frame(spark, old), sd.snapshot_frame(spark, {"users": new["public.Users"], "fresh": new["fresh"]}))
    assert {(r["table"], r["name"]): r["change"] for r in frame.collect()} == {("users", "id"): "changed", ("users", "name"): "changed", ("users", "gone"): "removed", ("users", "extra"): "added", ("dead", "id"): "removed", ("fresh", "id"): "added"}


def test_check_expressions():
    assert sd.parse_check("CHECK ((price >= 0 AND price < 100))") == {"price": {"min": 0.0, "max": 99.0}}
    assert sd.parse_check("CHECK (((status)::text = ANY ((ARRAY['a'::text, 'b'::text])::text[])))") == {"status": {"enum": ["a", "b"]}}
    assert sd.parse_check("CHECK (age BETWEEN 18 AND 65)") == {"age": {"min": 18.0, "max": 65.0}}
    assert sd.parse_check("CHECK (length(code) > 3)") == {"code": {"minLength": 4}}
    assert sd.parse_check("CHECK (end_at > start_at)") == {"end_at": {"gtColumn": "start_at"}}
    assert sd.parse_check("CHECK (x > 1.5)") == {"x": {"min": 1.5}}


def test_code(spark):
    s = social()
    for kind in codegen.TARGETS:
        name, code = codegen.generate(s, kind)
        assert name and "omment" in code
    assert '@relation("comments_post_id", fields: [post_id], references: [id])' in codegen.prisma(s)
    assert ".references(() => postTable.id)" in codegen.drizzle(s) and 'ref: "Post"' in codegen.mongoose(s) and "@ManyToOne(() => Post)" in codegen.typeorm(s)
    scope: dict = {}
    exec(codegen.struct_types(s), scope)  # noqa: S102
    assert scope["users"].fieldNames() == [f.name for f in s.table("users").fields]
    text = codegen.diagram(s, "Social")
    assert text.startswith("## Social\n\n```mermaid\nerDiagram\n") and "COMMENTS }o--|| POSTS" in text and "*7 tables, 30 fields*" in text
    with pytest.raises(ValueError, match="unknown target"):
        codegen.generate(s, "cobol")


def test_design_and_loose_schemas():
    d = design.design([{"name": "Blog Posts", "fields": [{"name": "title", "type": "varchar", "max_length": 80}]}, {"name": "users", "add_standard_fields": False, "fields": [{"name": "uid", "type": "int", "is_primary_key": True}]}], [{"from_collection": "blog posts", "to_collection": "users", "type": "many-to-one"}])
    assert [f.name for f in d.table("blog_posts").fields] == ["id", "title", "created_at", "updated_at", "users_id"] and d.table("blog_posts").field("users_id").type == "integer"
    assert Schema.from_json(d.to_json()) == d
    t = design.parse({"t": {"_id": "x", "n": 3, "x": 2.5, "b": True, "at": "2024-01-01T00:00:00Z", "tags": ["a"], "geo": {"lat": 1, "lng": 2}, "o": {"k": {"z": 1}}, "none": None}}).tables[0]
    assert {f.name: f.type for f in t.fields} == {"_id": "objectid", "n": "integer", "x": "number", "b": "boolean", "at": "timestamp", "tags": "array", "geo": "geopoint", "o": "object", "none": "null"}
    assert t.fields[0].name == "_id" and t.field("tags").arrayItemType == "string" and t.field("o").objectFields[0].objectFields[0].name == "z"


def test_spec_round_trip():
    t = Table("t", [key(), Field("x", "decimal", constraints=Constraints(min=1, enum=[1, 2])), Field("u", "integer", references="users")])
    back = Table.of("t", t.struct_type())
    assert back.field("x").constraints == t.field("x").constraints and back.keys()[0].name == "id" and back.field("u").references == "users"


@pytest.mark.parametrize("schema, code", [
    ([{"name": "t", "fields": []}], "NO_FIELDS"), ([{"name": "", "fields": [{"name": "id"}]}], "MISSING_COLLECTION_NAME"), ([{"name": "a b", "fields": [{"name": "id"}]}], "COLLECTION_NAME_HAS_SPACES"),
    ([{"name": "t", "fields": [{"name": "x"}, {"name": "x"}]}], "DUPLICATE_FIELD_NAME"), ([{"name": "t", "fields": [{"name": " "}]}], "MISSING_FIELD_NAME"), ([{"name": "t", "fields": [{"name": "u", "references": "nope", "type": "integer"}]}], "UNRESOLVED_FK_REFERENCE"),
    ([{"name": "t", "fields": [{"name": "u", "type": "integer", "constraints": {"enum": [1]}}]}], "ENUM_ON_NON_STRING"), ([{"name": "t", "fields": [{"name": "u", "type": "string", "constraints": {"min": 1}}]}], "MIN_ON_STRING"), ([{"name": "t", "fields": [{"name": "u", "type": "array"}]}], "ARRAY_MISSING_ITEM_TYPE"),
    ([{"name": "t", "fields": [{"name": "u", "type": "object"}]}], "OBJECT_MISSING_FIELDS"), ([{"name": "t", "fields": [{"name": "u v", "type": "string"}]}], "FIELD_NAME_HAS_SPACES"), ([{"name": "t", "fields": [{"name": "u", "type": "string"}]}], "NO_PRIMARY_KEY"),
    ([{"name": "t", "fields": [{"name": n, "type": "integer", "isPrimaryKey": True} for n in "abc"]}], "MANY_PRIMARY_KEYS"), ([{"name": "t", "fields": [{"name": "u", "type": "string"}]}], "MISSING_CREATED_AT"), ("{", "SCHEMA_PARSE_ERROR"),
    ({"tables": [{"name": "t", "fields": [{"name": "u"}]}], "relations": [{"id": "1", "fromTable": "t", "toTable": "x"}, {"id": "1", "fromTable": "y", "toTable": "t"}]}, "DUPLICATE_RELATIONSHIP_ID"),
    ({"tables": [{"name": "t", "fields": [{"name": "u"}]}], "relations": [{"fromTable": "y", "toTable": "t"}]}, "RELATIONSHIP_UNKNOWN_FROM"), ({"tables": [{"name": "t", "fields": [{"name": "u"}]}], "relations": [{"fromTable": "t", "toTable": "x"}]}, "RELATIONSHIP_UNKNOWN_TO"),
    ({"tables": [{"name": "t", "fields": [{"name": "u"}]}], "relations": [{"fromTable": "t", "toTable": "t"}]}, "SELF_REFERENTIAL_RELATIONSHIP"),
])
def test_lint(schema, code):
    assert code in {i["code"] for i in design.lint(schema, strict=True)}


def test_tools(spark, tmp_path):
    schema = [{"name": "users", "fields": [{"name": "id", "type": "integer", "isPrimaryKey": True}, {"name": "name", "type": "string", "required": True}]}]
    out = tools.generate_data(spark, json.dumps(schema), 8)
    assert out["tables"]["users"]["rows"] == 8 and len(out["tables"]["users"]["preview"]) == 5 and out["tables"]["users"]["preview"][0]["id"] == 1
    assert tools.generate_data(spark, schema, 3, output="sql")["tables"]["users"]["preview"][0].startswith("INSERT INTO users (id, name) VALUES (1, '")
    assert tools.generate_data(spark, schema, 3, output="csv")["tables"]["users"]["preview"][0] == "id,name"
    seeded = tools.seed_database(spark, schema, 20, "parquet", str(tmp_path / "x"), truncate_first=True)
    assert seeded["rows"] == 20 and not seeded["errors"] and spark.read.parquet(str(tmp_path / "x/users")).count() == 20
    with pytest.raises(ValueError, match="production"):
        tools.seed_database(spark, schema, 1, "postgresql", "jdbc:postgresql://prod-db/x")
    assert tools.validate_schema(schema)["valid"] and tools.diff_schemas(schema, schema)["totalChanges"] == 0
    assert "erDiagram" in tools.visualize_schema(schema) and tools.design_schema([{"name": "a"}])["tables"][0]["name"] == "a"
    assert design.friendly(RuntimeError("connect ECONNREFUSED 1.2.3.4")).startswith("The server can't be reached")
