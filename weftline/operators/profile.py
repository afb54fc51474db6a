"""Profiles: types of JSON members, types of text values, sizes, samples, schemas of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Field, Table, spec_type

NUMERIC_TEXT = r"^-?\d+\.?\d*$"
UUID_TEXT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def json_type(value: Column) -> Column:
    """The type of a variant: null, boolean, number, string, date, array or object."""
    t = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (t == "VOID"), "null").when(t == "BOOLEAN", "boolean").when(t.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), "number")
        .when(t == "STRING", "string").when(t.rlike("^(DATE|TIMESTAMP)"), "date").when(t.startswith("ARRAY"), "array").otherwise("object")
    )


def document_type(value: Column) -> Column:
    """As json_type(), but objects as a document store writes its own types: reference (a path), geopoint, timestamp and bytes."""
    has = lambda *names: F.array_size(F.array_compact(F.array(*[F.try_variant_get(value, f"$.{n}", "string") for n in names]))) == len(names)
    kind = json_type(value)
    own = F.when(has("path"), "reference").when(has("latitude", "longitude") | has("_latitude", "_longitude") | has("lat", "lng"), "geopoint").when(has("_seconds"), "timestamp").when(has("_bytes"), "bytes")
    return F.when(kind == "object", F.coalesce(own, kind)).otherwise(kind)


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """key and value (variant) of each member of a column of JSON objects; what isn't one has none."""
    parsed = F.try_parse_json(F.col(column))
    members = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.try_variant_get(parsed, "$", "map<string,variant>"))
    return df.select(F.explode(members).alias("key", "value"))


def type_histogram(df: DataFrame, column: str, type_of=json_type) -> DataFrame:
    """key, type, n and dominant (the type with most values but null, the first by name on a tie)."""
    counts = json_fields(df, column).groupBy("key", type_of(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("type") == "null", F.desc("n"), "type"))
    return counts.withColumn("dominant", rank == 1)


def item_types(df: DataFrame, column: str) -> DataFrame:
    """key and items of each member that is an array anywhere: object, primitive or mixed, by all of its elements; primitive without any."""
    lists = json_fields(df, column).where(json_type(F.col("value")) == "array")
    items = lists.select("key", F.explode_outer(F.try_variant_get("value", "$", "array<variant>")).alias("item"))
    kind = json_type(F.col("item"))
    sums = items.groupBy("key").agg(F.coalesce(F.bool_or(kind == "object"), F.lit(False)).alias("o"), F.coalesce(F.bool_or(F.col("item").isNotNull() & (kind != "object")), F.lit(False)).alias("p"))
    return sums.select("key", F.when(F.col("o") & F.col("p"), "mixed").when(F.col("o"), "object").otherwise("primitive").alias("items"))


def infer_table(df: DataFrame, column: str, name: str, type_of=json_type) -> Table:
    """The fields of a column of JSON documents: dominant type, nullable if any is null or missing; _id first, then by name. type_of: document_type
    where the documents come from a store with types of its own."""
    total = df.count()
    seen: dict[str, dict] = {}
    for r in type_histogram(df, column, type_of).collect():
        own = seen.setdefault(r["key"], {"n": 0, "null": 0, "type": "null"})
        own["n"] += r["n"]
        if r["type"] == "null":
            own["null"] += r["n"]
        if r["dominant"]:
            own["type"] = {"number": "number", "date": "timestamp"}.get(r["type"], r["type"])
    if not seen:
        return Table(name, [Field("_id", "objectid", True, primaryKey=True)])
    items = {r["key"]: r["items"] for r in item_types(df, column).collect()} if any(v["type"] == "array" for v in seen.values()) else {}
    fields = [Field(k, v["type"], arrayItemType=items.get(k) if v["type"] == "array" else None, required=not v["null"] and v["n"] >= total, primaryKey=k == "_id") for k, v in seen.items()]
    return Table(name, sorted(fields, key=lambda f: (f.name != "_id", f.name)))


def table_of(name: str, df: DataFrame) -> Table:
    return Table(name, [Field(f.name, spec_type(f.dataType), not f.nullable) for f in df.schema.fields])


def value_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n, numeric_ratio, uuid_ratio, is_numeric, is_uuid and average_length of text columns, in one scan."""
    sums = []
    for c in columns:
        sums += [F.count(c).alias(f"n_{c}"), F.count_if(F.col(c).rlike(NUMERIC_TEXT)).alias(f"d_{c}"), F.count_if(F.col(c).rlike(UUID_TEXT)).alias(f"u_{c}"), F.sum(F.length(c)).alias(f"l_{c}")]
    pairs = ", ".join(f"'{c}', `n_{c}`, `d_{c}`, `u_{c}`, `l_{c}`" for c in columns)
    out = df.agg(*sums).selectExpr(f"stack({len(columns)}, {pairs}) as (field, n, n_numeric, n_uuid, n_chars)")
    ratio = lambda c: F.coalesce(F.try_divide(c, "n"), F.lit(0.0))
    return out.select("field", "n", ratio("n_numeric").alias("numeric_ratio"), ratio("n_uuid").alias("uuid_ratio"), (ratio("n_numeric") > 0.8).alias("is_numeric"), (ratio("n_uuid") > 0.8).alias("is_uuid"), ratio("n_chars").alias("average_length"))


def sample_size(n: Column) -> Column:
    """All below 1,000 rows; 1 % but at least 100 up to 100,000; 0.1 % but at least 1,000 beyond."""
    return F.when(n < 1000, n).when(n <= 100_000, F.greatest(F.lit(100), F.floor(n / 100))).otherwise(F.greatest(F.lit(1000), F.floor(n / 1000))).cast("long")


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table and n_rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out
