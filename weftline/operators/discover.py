"""Relationships found in data: value overlap of columns with keys, and evidence from names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import name_evidence, singular

#: A pair is a candidate if at least so many of the child's values are keys, and reported from this confidence on.
LEAST_ACCURACY, LEAST_CONFIDENCE = 0.5, 0.65
# Endings of ids that belong to other systems.
FOREIGN_ENDINGS = ("external_id", "stripe_id", "legacy_id")


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return family(kind.elementType)
    return "number" if isinstance(kind, T.NumericType) else "string" if isinstance(kind, T.StringType) else kind.typeName()


@dataclass
class Candidate:
    child: str
    column: str
    parent: str
    key: str
    is_array: bool = False
    unique: bool = False


def candidates(tables: dict[str, DataFrame], keys: dict[str, str], unique: set[tuple[str, str]] = frozenset()) -> list[Candidate]:
    """Pairs of a column and another table's key with types of one family. Metadata only."""
    out = []
    for child, df in tables.items():
        for f in df.schema.fields:
            if f.name == keys.get(child):
                continue
            for parent, key in keys.items():
                if parent != child and family(f.dataType) == family(tables[parent].schema[key].dataType) in ("number", "string"):
                    out.append(Candidate(child, f.name, parent, key, isinstance(f.dataType, T.ArrayType), (child, f.name) in unique))
    return out


def typed(c: Column, kind: T.DataType) -> Column:
    """A value as a number if it is a whole one of a numeric type, else as text; both null if it is null."""
    none = F.lit(None)
    if isinstance(kind, T.IntegralType):
        return F.struct(c.cast("bigint").alias("number"), none.cast("string").alias("text"))
    if isinstance(kind, T.NumericType):
        number = c.try_cast("bigint")
        same = F.coalesce(number == c, F.lit(False))
        return F.struct(F.when(same, number).alias("number"), F.when(~same, c.cast("string")).alias("text"))
    return F.struct(none.cast("bigint").alias("number"), c.cast("string").alias("text"))


def tagged(kind: T.DataType, field: int | None, key: int | None):
    return lambda v: F.struct(typed(v, kind).alias("value"), F.lit(field).cast("int").alias("field"), F.lit(key).cast("int").alias("key"))


def overlap(tables: dict[str, DataFrame], pairs: list[Candidate]) -> DataFrame:
    """child, field, parent, n_valid, n_matched, n_distinct, n_keys, accuracy and coverage for each candidate.

    Each table is scanned once: its columns and keys are unpivoted and counted by value before one shuffle by value, in which a value that
    fills half a column is a single row. There the columns and the keys that have a value meet, as two lists no longer than the list of
    pairs, and the counts of every pair are sums over them.
    """
    fields = {key: k for k, key in enumerate(dict.fromkeys((p.child, p.column) for p in pairs))}
    keys = {key: k for k, key in enumerate(dict.fromkeys((p.parent, p.key) for p in pairs))}
    seen = None
    for name in dict.fromkeys([*(c for c, _ in fields), *(p for p, _ in keys)]):
        df, lists = tables[name], []
        for no, places in enumerate((fields, keys)):
            for (own, column), k in places.items():
                if own != name:
                    continue
                kind, c = df.schema[column].dataType, F.col(column)
                place = (None, k) if no else (k, None)
                if isinstance(kind, T.ArrayType):
                    lists.append(F.transform(F.coalesce(c, F.array().cast(kind)), tagged(kind.elementType, *place)))
                else:
                    lists.append(F.array(tagged(kind, *place)(c)))
        flat = df.select(F.explode(F.concat(*lists)).alias("x")).select("x.value.*", "x.field", "x.key").where("number is not null or text is not null")
        flat = flat.groupBy("number", "text", "field", "key").agg(F.count(F.lit(1)).alias("n"))
        seen = flat if seen is None else seen.unionByName(flat)
    met = seen.groupBy("number", "text").agg(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "n"))).alias("fields"), F.collect_set("key").alias("keys"))
    none, one = F.lit(-1), F.lit(1).cast("long")
    hits = F.flatten(F.transform("fields", lambda f: F.transform(F.concat(F.array(none), F.col("keys")), lambda k: F.struct(f["field"].alias("field"), k.alias("key"), f["n"].alias("n")))))
    held = F.transform("keys", lambda k: F.struct(none.alias("field"), k.alias("key"), one.alias("n")))
    sums = met.select(F.explode(F.concat(hits, held)).alias("x")).groupBy("x.field", "x.key").agg(F.sum("x.n").alias("n"), F.count(F.lit(1)).alias("n_values"))
    # a few rows: each goes to the pairs that it tells something of
    named = [(k, p.child, p.column, p.parent, fields[p.child, p.column], keys[p.parent, p.key]) for k, p in enumerate(pairs)]
    wanted = seen.sparkSession.createDataFrame(named, "pair int, child string, field string, parent string, _f int, _k int")
    told = wanted.select("pair", F.explode(F.array(F.struct(F.col("_f").alias("field"), F.col("_k").alias("key")), F.struct(F.col("_f").alias("field"), none.alias("key")), F.struct(none.alias("field"), F.col("_k").alias("key")))).alias("at")).select("pair", F.col("at.field").alias("_field"), F.col("at.key").alias("_key"))
    by_pair = told.join(sums, (F.col("field") == F.col("_field")) & (F.col("key") == F.col("_key"))).groupBy("pair")
    of = lambda which, what: F.sum(F.when(which, F.col(what)))
    both = (F.col("field") >= 0) & (F.col("key") >= 0)
    found = by_pair.agg(of(F.col("key") < 0, "n").alias("n_valid"), of(both, "n").alias("n_matched"), of(both, "n_values").alias("n_distinct"), of(F.col("field") < 0, "n").alias("n_keys"))
    zero = F.lit(0).cast("long")
    out = wanted.join(found, "pair", "left").select("child", "field", "parent", *[F.coalesce(c, zero).alias(c) for c in ("n_valid", "n_matched", "n_distinct", "n_keys")])
    return out.withColumn("accuracy", F.coalesce(F.try_divide("n_matched", "n_valid"), F.lit(0.0))).withColumn("coverage", F.coalesce(F.try_divide("n_distinct", "n_keys"), F.lit(0.0)))


def name_confidence(p: Candidate, indexed: bool) -> float | None:
    """What a column's name says for a reference; None where it says nothing."""
    e = name_evidence(p.column, p.parent)
    if e["similarity"] < 0.6 and not (e["suffix"] or e["exact"] or e["containment"]):
        return None
    return round(min(0.5 + 0.3 * e["suffix"] + 0.25 * e["exact"] + 0.15 * (e["containment"] and not e["exact"]) + 0.1 * (e["similarity"] > 0.8) + 0.1 * indexed, 1.0), 10)


def discover(tables: dict[str, DataFrame], keys: dict[str, str], unique: set[tuple[str, str]] = frozenset(), indexed: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """parentTable, childTable, column, confidence (by names), type, isArrayReference, accuracy, coverage and score of each relationship that the
    data and the names support, each by itself and as score: confidence() over both; type: by uniqueness where that is declared, else cardinality() of the values.
    Of the parents of a column those with the best names stay."""
    pairs = candidates(tables, keys, unique)
    spark = next(iter(tables.values())).sparkSession
    schema = "parentTable string, childTable string, column string, confidence double, isArrayReference boolean, _unique boolean, _similarity double, _suffix boolean, _same boolean"
    named, chosen = [], []
    for p in pairs:
        sure = name_confidence(p, (p.parent, p.column) in indexed)
        if sure is not None and sure >= LEAST_CONFIDENCE:
            e = name_evidence(p.column, p.parent)
            same = type_of(tables[p.child].schema[p.column].dataType) == type_of(tables[p.parent].schema[p.key].dataType)
            named.append((p.parent, p.child, p.column, sure, p.is_array, p.unique, float(e["similarity"]), bool(e["suffix"]), same))
            chosen.append(p)
    columns = ["parentTable", "childTable", "column", "confidence", "type", "isArrayReference", "accuracy", "coverage", "score"]
    if not named:
        return spark.createDataFrame([], "parentTable string, childTable string, column string, confidence double, type string, isArrayReference boolean, accuracy double, coverage double, score double")
    seen = overlap(tables, chosen).where((F.col("n_valid") > 0) & (F.col("accuracy") >= LEAST_ACCURACY)).withColumnsRenamed({"child": "_c", "field": "_f", "parent": "_p"})
    out = spark.createDataFrame(named, schema).join(seen, (F.col("childTable") == F.col("_c")) & (F.col("column") == F.col("_f")) & (F.col("parentTable") == F.col("_p")))
    kind = F.when(F.col("_unique") & ~F.col("isArrayReference"), "1:1").otherwise(cardinality(F.col("n_distinct"), F.col("n_matched"), F.col("isArrayReference")))
    fits = type_score(F.when(F.col("_same"), "Number").otherwise("Other"), F.lit("Number"), F.lit(False), F.lit(100))
    score = confidence(F.col("coverage"), F.col("_similarity"), F.col("_suffix"), (F.lit(1.0) - F.col("accuracy")) * 100, fits, F.lit(0.0))
    out = out.withColumns({"type": kind, "score": score}).where(F.col("score") >= LEAST_CONFIDENCE)
    best = F.max("confidence").over(Window.partitionBy("childTable", "column"))  # a row for each candidate, so a few
    return out.withColumn("_best", best).where(F.col("confidence") == F.col("_best")).select(*columns)


def type_of(kind: T.DataType) -> str:
    """As family(), but whole numbers, other numbers and texts apart."""
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return "whole" if isinstance(kind, T.IntegralType) else family(kind)


def by_names(tables: dict[str, T.StructType], keys: dict[str, str]) -> list[dict]:
    """References told from names and types alone: table_id, tableid or its singular, to tables with a single key."""
    out = []
    for child, schema in tables.items():
        for f in schema.fields:
            low = f.name.lower()
            if low == "id" or low.endswith(FOREIGN_ENDINGS):
                continue
            for parent, key in keys.items():
                one = singular(parent.lower())
                if parent == child or low not in {f"{t}{e}" for t in (parent.lower(), one) for e in ("_id", "id")} or family(f.dataType) != family(tables[parent][key].dataType):
                    continue
                out.append({"parentTable": parent, "childTable": child, "column": f.name, "confidence": min(0.75, 0.5 + 0.2 + 0.1 * low.endswith("_id")), "type": "1:N"})
    return out


def by_paths(df: DataFrame, path: str, column: str) -> DataFrame:
    """parentTable, childTable, column, confidence, type and isArrayReference that a document store's own references declare.

    path: of each document, collection/id or collection/id/subcollection/id and so on. A member that is an object with a path refers to the path's
    first collection; so do lists of such (N:M). A document in a subcollection refers to the collection above it by _parent.
    """
    parts = F.split(F.trim(F.col(path), F.lit("/")), "/")
    rows = df.select(parts.alias("_parts"), column).where(F.size("_parts") >= 2).select(F.get("_parts", F.size("_parts") - 2).alias("childTable"), F.get("_parts", F.size("_parts") - 4).alias("_above"), column)
    members = rows.withColumn("_data", F.try_parse_json(F.col(column)))
    members = members.select("childTable", F.explode(F.when(F.schema_of_variant("_data").startswith("OBJECT"), F.try_variant_get("_data", "$", "map<string,variant>"))).alias("column", "value"))
    is_list = F.schema_of_variant("value").startswith("ARRAY")
    target = lambda at: F.get(F.split(F.trim(F.try_variant_get("value", at, "string"), F.lit("/")), "/"), 0)
    whole = lambda at: F.size(F.split(F.trim(F.try_variant_get("value", at, "string"), F.lit("/")), "/")) >= 2
    told = members.select("childTable", "column", is_list.alias("isArrayReference"), F.when(is_list & whole("$[0].path"), target("$[0].path")).when(~is_list & whole("$.path"), target("$.path")).alias("parentTable")).where("parentTable is not null")
    above = rows.where("_above is not null").select("childTable", F.lit("_parent").alias("column"), F.lit(False).alias("isArrayReference"), F.col("_above").alias("parentTable"))
    out = told.unionByName(above).distinct()
    return out.select("parentTable", "childTable", "column", F.lit(1.0).alias("confidence"), F.when(F.col("isArrayReference"), "N:M").otherwise("1:N").alias("type"), "isArrayReference")


def confidence(coverage: Column, similarity: Column, suffix: Column, out_of_range: Column, same_type: Column, risk: Column) -> Column:
    """The weighted score of a candidate; it can pass 1, as its weights sum to 1.1. Rounded to two places."""
    raw = F.least(coverage, F.lit(1.0)) * 0.40 + similarity * 0.25 + suffix.cast("double") * 0.20 + (F.lit(1.0) - F.least(out_of_range / 100, F.lit(1.0))) * 0.10 + same_type.cast("double") * 0.15
    return F.floor(raw * (F.lit(1.0) - risk * 0.3) * 100 + 0.5) / 100


def cardinality(n_matched: Column, n_parent: Column, is_array: Column) -> Column:
    """N:M for arrays, 1:N where over half of the second number has no match of its own in the first, else 1:1."""
    return F.when(is_array, "N:M").when(F.lit(1.0) - F.try_divide(n_matched, n_parent) > 0.5, "1:N").otherwise("1:1")


def type_score(field_type: Column, key_type: Column, is_uuid: Column, share: Column) -> Column:
    """How well a field's type goes with a key's, 0 to 1. share: percent of the field's main type, if it has several."""
    same = field_type == key_type
    return F.when(same & field_type.isin("ObjectId", "String", "Number"), 1.0).when(key_type == "ObjectId", 0.0).when(is_uuid & (key_type == "String"), 0.95).when(share < 100, share / 100).otherwise(0.0)
