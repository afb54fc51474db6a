"""Schemas and relationships as a database's own catalogue declares them.

The catalogue is five tables in the shape of information_schema (columns, table_constraints, key_column_usage, referential_constraints,
check_constraints), read over JDBC by load() or given as DataFrames; everything else is joins and aggregates over them. Only the finished
description, a few rows a table, comes to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import Constraints, Field, Relation, Schema, Table, canonical_type, made
from .schema_diff import parse_check

# The views of the SQL standard, and the columns of each that are read.
VIEWS = {
    "columns": ["table_schema", "table_name", "column_name", "ordinal_position", "data_type", "is_nullable", "column_default", "character_maximum_length"],
    "table_constraints": ["constraint_schema", "constraint_name", "table_schema", "table_name", "constraint_type"],
    "key_column_usage": ["constraint_schema", "constraint_name", "table_schema", "table_name", "column_name", "ordinal_position", "position_in_unique_constraint"],
    "referential_constraints": ["constraint_schema", "constraint_name", "unique_constraint_schema", "unique_constraint_name"],
    "check_constraints": ["constraint_schema", "constraint_name", "check_clause"],
}
# SQLite's catalogue functions, for a table.
SQLITE = {"columns": "SELECT * FROM pragma_table_info('{table}')", "foreign_keys": "SELECT * FROM pragma_foreign_key_list('{table}')", "indexes": "SELECT * FROM pragma_index_list('{table}')"}
# Defaults that number rows.
SERIAL = ("nextval(", "auto_increment", "identity")


@dataclass
class Catalog:
    columns: DataFrame
    table_constraints: DataFrame
    key_column_usage: DataFrame
    referential_constraints: DataFrame
    check_constraints: DataFrame


def load(spark: SparkSession, url: str, schemas: list[str] | None = None, **options) -> Catalog:
    """The catalogue of a database over JDBC; the restriction to schemas reaches the database."""

    def view(name: str) -> DataFrame:
        df = spark.read.format("jdbc").options(url=url, dbtable=f"information_schema.{name}", **options).load()
        df = df.toDF(*[c.lower() for c in df.columns])
        for c in VIEWS[name]:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("string"))
        own = "table_schema" if "table_schema" in VIEWS[name] else "constraint_schema"
        return df.select(*VIEWS[name]).where(F.col(own).isin(schemas)) if schemas else df.select(*VIEWS[name])

    return Catalog(**{name: view(name) for name in VIEWS})


def keys(catalog: Catalog, *kinds: str) -> DataFrame:
    """table_schema, table_name, constraint_name, constraint_type, columns (in order) of each key of the kinds given."""
    on = ["constraint_schema", "constraint_name", "table_schema", "table_name"]
    both = catalog.table_constraints.where(F.col("constraint_type").isin(list(kinds))).join(catalog.key_column_usage, on)
    by = ["table_schema", "table_name", "constraint_name", "constraint_type"]
    return both.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("ordinal_position").cast("int"), "column_name"))).alias("c")).select(*by, F.transform("c", lambda c: c["column_name"]).alias("columns"))


def foreign_keys(catalog: Catalog) -> DataFrame:
    """Declared references: constraint_name, child and parent tables, their columns in step, type (1:1 if the child's columns are a key of it) and confidence."""
    use = catalog.key_column_usage
    theirs = use.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal_position").cast("int").alias("_at"), F.col("table_schema").alias("parent_schema"), F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"))
    mine = use.select("constraint_schema", "constraint_name", F.col("table_schema").alias("child_schema"), F.col("table_name").alias("child_table"), "column_name", F.col("ordinal_position").cast("int").alias("_no"), F.coalesce(F.col("position_in_unique_constraint"), F.col("ordinal_position")).cast("int").alias("_at"))
    both = mine.join(catalog.referential_constraints, ["constraint_schema", "constraint_name"]).join(theirs, ["unique_constraint_schema", "unique_constraint_name", "_at"])
    by = ["constraint_name", "child_schema", "child_table", "parent_schema", "parent_table"]
    refs = both.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_no", "column_name", "parent_column"))).alias("c"))
    refs = refs.select(*by, F.transform("c", lambda c: c["column_name"]).alias("columns"), F.transform("c", lambda c: c["parent_column"]).alias("parent_columns"))
    own = keys(catalog, "PRIMARY KEY", "UNIQUE").select(F.col("table_schema").alias("child_schema"), F.col("table_name").alias("child_table"), F.sort_array("columns").alias("_key")).distinct()
    out = refs.withColumn("_key", F.sort_array("columns")).join(own.withColumn("_one", F.lit(True)), ["child_schema", "child_table", "_key"], "left")
    return out.select(*by, "columns", "parent_columns", F.when(F.col("_one"), "1:1").otherwise("1:N").alias("type"), F.lit(1.0).alias("confidence"))


def described(catalog: Catalog) -> DataFrame:
    """A row for each column: its place and type, key_index in the primary key, whether it is unique by itself, its reference, and the CHECK clauses of its table."""
    at = ["table_schema", "table_name"]
    primary = keys(catalog, "PRIMARY KEY").select(*at, F.posexplode("columns").alias("key_index", "column_name"))
    single = keys(catalog, "PRIMARY KEY", "UNIQUE").where(F.size("columns") == 1).select(*at, F.col("columns")[0].alias("column_name"), F.lit(True).alias("is_unique")).distinct()
    refs = foreign_keys(catalog).select(F.col("child_schema").alias("table_schema"), F.col("child_table").alias("table_name"), "constraint_name", F.size("columns").alias("_n"), "parent_table", F.explode(F.arrays_zip("columns", "parent_columns")).alias("z"))
    refs = refs.select(*at, F.col("z.columns").alias("column_name"), F.concat_ws(".", "parent_table", "z.parent_columns").alias("reference"), F.when(F.col("_n") > 1, F.col("constraint_name")).alias("reference_group"))
    refs = refs.groupBy(*at, "column_name").agg(F.min(F.struct("reference", "reference_group")).alias("r")).select(*at, "column_name", "r.reference", "r.reference_group")
    checks = catalog.table_constraints.where("constraint_type = 'CHECK'").join(catalog.check_constraints, ["constraint_schema", "constraint_name"]).groupBy(*at).agg(F.sort_array(F.collect_set("check_clause")).alias("checks"))
    out = catalog.columns.select(*at, "column_name", F.col("ordinal_position").cast("int").alias("ordinal_position"), "data_type", (F.upper("is_nullable") == "YES").alias("nullable"), "column_default", F.col("character_maximum_length").cast("int").alias("max_length"))
    out = out.join(primary, [*at, "column_name"], "left").join(single, [*at, "column_name"], "left").join(refs, [*at, "column_name"], "left").join(checks, at, "left")
    return out.withColumn("is_unique", F.coalesce("is_unique", F.lit(False)))


def schema_of(catalog: Catalog, qualified: bool = False) -> Schema:
    """The declared schema: types, keys, references, lengths, defaults and what CHECK clauses imply."""
    name = lambda s, t: f"{s}.{t}" if qualified else t
    tables: dict[str, Table] = {}
    for r in described(catalog).orderBy("table_schema", "table_name", "ordinal_position").collect():
        table = tables.setdefault(name(r["table_schema"], r["table_name"]), Table(name(r["table_schema"], r["table_name"]), schema=r["table_schema"]))
        implied: dict = {}
        for clause in r["checks"] or ():
            implied |= parse_check(clause).get(r["column_name"], {})
        if r["max_length"]:
            implied.setdefault("maxLength", r["max_length"])
        primary = r["key_index"] is not None
        if r["is_unique"] and not primary:
            implied["unique"] = True
        default = r["column_default"]
        serial = bool(default) and any(x in default.lower() for x in SERIAL)
        table.fields.append(Field(
            r["column_name"], canonical_type(r["data_type"]), not r["nullable"], None if serial else unquoted(default), made(Constraints, implied), primary, r["reference"] is not None, r["reference"],
            rawType=r["data_type"], isSerial=serial, keyIndex=r["key_index"] if primary else None, group=r["reference_group"],
        ))
    relations = []
    for r in foreign_keys(catalog).orderBy("child_schema", "child_table", "constraint_name").collect():
        child, parent = name(r["child_schema"], r["child_table"]), name(r["parent_schema"], r["parent_table"])
        kind = "one-to-one" if r["type"] == "1:1" else "many-to-one"
        if len(r["columns"]) == 1:
            relations.append(Relation(child, parent, kind, r["columns"][0], r["parent_columns"][0], id=r["constraint_name"]))
        else:
            relations.append(Relation(child, parent, kind, fromFields=r["columns"], toFields=r["parent_columns"], id=r["constraint_name"]))
    return Schema(list(tables.values()), relations)


def from_describe(name: str, rows: DataFrame) -> Table:
    """A table from DESCRIBE's rows: Field, Type, Null, Key (PRI, UNI), Default, Extra."""
    out = Table(name)
    for k, r in enumerate(rows.toDF(*[c.lower() for c in rows.columns]).collect()):
        kind, enum = str(r["type"]), re.match(r"(?:enum|set)\((.*)\)", str(r["type"]), re.I)
        sized = re.match(r"(?:var)?char(?:acter varying)?\((\d+)\)", kind, re.I)
        limits = Constraints(enum=[x.strip().strip("'") for x in enum[1].split(",")] if enum else None, maxLength=int(sized[1]) if sized else None, unique=True if r["key"] == "UNI" else None)
        serial = any(x in str(r["extra"] or "").lower() for x in SERIAL)
        out.fields.append(Field(r["field"], "string" if enum else canonical_type(kind), r["null"] == "NO", unquoted(r["default"]), limits, r["key"] == "PRI", rawType=kind, isSerial=serial, keyIndex=k if r["key"] == "PRI" else None))
    return out


def from_pragma(name: str, columns: DataFrame, references: DataFrame | None = None, unique: list[list[str]] = ()) -> tuple[Table, list[Relation]]:
    """A table and its references from SQLite's table_info (cid, name, type, notnull, dflt_value, pk) and foreign_key_list (id, seq, table, from, to)."""
    out, relations = Table(name), []
    for r in columns.orderBy("cid").collect():
        limits = Constraints(unique=True if [r["name"]] in unique else None)
        out.fields.append(Field(r["name"], canonical_type(r["type"]), bool(r["notnull"]), unquoted(r["dflt_value"]), limits, r["pk"] > 0, rawType=r["type"], isSerial=r["pk"] > 0 and str(r["type"]).upper() == "INTEGER", keyIndex=r["pk"] - 1 if r["pk"] else None))
    groups: dict[int, list] = {}
    for r in references.orderBy("id", "seq").collect() if references is not None else ():
        groups.setdefault(r["id"], []).append(r)
    for own in groups.values():
        mine, theirs = [r["from"] for r in own], [r["to"] for r in own]
        kind = "one-to-one" if mine in unique or mine == [f.name for f in out.keys()] else "many-to-one"
        relations.append(Relation(name, own[0]["table"], kind, mine[0], theirs[0]) if len(own) == 1 else Relation(name, own[0]["table"], kind, fromFields=mine, toFields=theirs))
        for c, t in zip(mine, theirs, strict=True):
            f = out.field(c)
            f.foreignKey, f.references = True, f"{own[0]['table']}.{t}" if t else own[0]["table"]
    return out, relations


def from_spark(spark: SparkSession, name: str) -> Table:
    """A table of Spark's catalogue, with what DESCRIBE says of its columns."""
    out = Table.of(name.split(".")[-1], spark.table(name).schema)
    said = {r["col_name"]: r["comment"] for r in spark.sql(f"DESCRIBE TABLE {name}").collect()}
    for f in out.fields:
        f.description = said.get(f.name)
    return out


def unquoted(default: str | None):
    """A declared default without its quotes and cast."""
    if default is None or default.strip().upper() in ("NULL", ""):
        return None
    bare = default.split("::")[0].strip().strip("()")
    return bare[1:-1].replace("''", "'") if bare[:1] == bare[-1:] == "'" and len(bare) > 1 else bare
