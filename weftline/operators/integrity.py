"""Checks across rows and tables: uniqueness, null rates, references, totals. All are joins and partial aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Relation


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """The values of columns that stand in more than one row, with their count. Null values are left out, as in a unique index."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(full).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, distinct values, repeated values and the rows that have one of them."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    counts = df.where(full).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_violating"))


def unique_rules(df: DataFrame, columns: list[str]) -> DataFrame:
    """rule, checked and violations, as constraints.report() has them, of the columns that must be unique: rows whose value isn't, and rows
    without a value. One scan counts the values of all columns."""
    lists = F.array(*[F.struct(F.lit(c).alias("field"), F.sha2(F.col(c).cast("string"), 256).alias("value")) for c in columns])
    counts = df.select(F.explode(lists).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
    broken = F.when(F.col("value").isNull() | (F.col("n") > 1), F.col("n")).otherwise(0)
    out = counts.groupBy("field").agg(F.sum("n").alias("checked"), F.sum(broken).alias("violations"))
    return out.select(F.concat(F.lit("unique:"), "field").alias("rule"), "checked", "violations")


def null_rates(df: DataFrame, columns: list[str], most: float, by: list[str] | None = None) -> DataFrame:
    """field, n_rows, n_null, rate and violated (rate > most) for each column, of each group if `by` is given."""
    by = by or []
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', `_{c}`" for c in columns)
    out = sums.selectExpr(*by, "n_rows", f"stack({len(columns)}, {pairs}) as (field, n_null)")
    return out.withColumn("rate", F.try_divide("n_null", "n_rows")).withColumn("violated", F.coalesce(F.col("rate") > most, F.lit(False)))


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows of child whose reference is set in full and has no parent. AQE chooses the join; a hot key is only probed."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    own = parent.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)])
    return child.where(full).join(own, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]), "left_anti")


def reference_report(tables: dict[str, DataFrame], relations: list[Relation]) -> DataFrame:
    """relation, parent, n_checked, n_null and n_orphans for each many-to-one or one-to-one relation.

    A child's references are unpivoted in one scan and counted by value before they meet the parents' keys in a single join, so the join
    sees each value of a relation once, however often it is used. Whole numbers stay numbers; composite and other keys meet as text.
    """
    ends = [((r.fromTable, tuple(r.fromFields or [r.fromField])), (r.toTable, tuple(r.toFields or [r.toField]))) for r in relations]
    schemas = {n: dict(tables[n].dtypes) for n in {t for pair in ends for t, _ in pair}}
    whole = [all(len(cols) == 1 and schemas[t][cols[0]] in ("tinyint", "smallint", "int", "bigint") for t, cols in pair) for pair in ends]
    parents = {key: k for k, key in enumerate(dict.fromkeys((*parent, w) for (_, parent), w in zip(ends, whole, strict=True)))}

    def value(cols: tuple[str, ...], number: bool) -> list[Column]:
        """The key as a number and as text, one of them null; both if a part is."""
        none = F.lit(None)
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        text = F.when(full, F.col(cols[0]).cast("string") if len(cols) == 1 else F.to_json(F.array(*[F.col(c).cast("string") for c in cols])))
        return [(F.col(cols[0]) if number else none).cast("bigint").alias("number"), (none if number else text).cast("string").alias("text")]

    used = None
    for name in dict.fromkeys(child for (child, _), _ in ends):
        own = [(k, cols, whole[k], parents[(*parent, whole[k])]) for k, ((child, cols), parent) in enumerate(ends) if child == name]
        rows = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(p).alias("parent_no"), *value(cols, w)) for k, cols, w, p in own])
        flat = tables[name].select(F.explode(rows).alias("x")).select("x.*").groupBy("no", "parent_no", "number", "text").agg(F.count(F.lit(1)).alias("n"))
        used = flat if used is None else used.unionByName(flat)
    held = None
    for (name, cols, w), k in parents.items():
        own = tables[name].select(F.lit(k).alias("_parent_no"), *[c.alias(f"_{n}") for c, n in zip(value(cols, w), ("number", "text"), strict=True)]).where("_number is not null or _text is not null").distinct()
        held = own if held is None else held.unionByName(own)
    set_ = F.col("number").isNotNull() | F.col("text").isNotNull()
    both = used.join(held, (F.col("parent_no") == F.col("_parent_no")) & (F.coalesce("number", F.lit(0)) == F.coalesce("_number", F.lit(0))) & (F.coalesce("text", F.lit("")) == F.coalesce("_text", F.lit(""))) & set_, "left")
    sums = both.groupBy("no").agg(F.sum("n").alias("n_checked"), F.sum(F.when(~set_, F.col("n"))).alias("n_null"), F.sum(F.when(set_ & F.col("_parent_no").isNull(), F.col("n"))).alias("n_orphans"))
    named = used.sparkSession.createDataFrame([(k, f"{r.fromTable}.{'+'.join(r.fromFields or [r.fromField])}", r.toTable) for k, r in enumerate(relations)], "no int, relation string, parent string")
    out = named.join(sums, "no", "left")
    return out.select("relation", "parent", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_checked", "n_null", "n_orphans")])


AGGREGATES = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "stddev": lambda c: F.stddev_samp(c),
}


def aggregation(df: DataFrame, kind: str, column: str | Column, by: list[str], having: str | Column, alias: str = "value", where: str | Column | None = None) -> DataFrame:
    """Groups whose aggregate breaks the rule: `having` says what must hold of `alias`."""
    value = F.col(column) if isinstance(column, str) else column
    rows = df if where is None else df.where(where)
    must = F.expr(having) if isinstance(having, str) else having
    return rows.groupBy(*by).agg(AGGREGATES[kind](value).alias(alias)).where(~F.coalesce(must, F.lit(False)))


def cross_table(base: DataFrame, key: str, other: DataFrame, other_key: str, kind: str, column: str | Column, must: str | Column, alias: str = "value") -> DataFrame:
    """Rows of base for which the aggregate over their rows of `other` breaks `must`. The other side is summed up before it is joined."""
    value = F.col(column) if isinstance(column, str) else column
    sums = other.groupBy(F.col(other_key).alias("_k")).agg(AGGREGATES[kind](value).alias(alias))
    both = base.join(sums, F.col(key) == F.col("_k"), "left").drop("_k")
    if kind == "count":
        both = both.withColumn(alias, F.coalesce(F.col(alias), F.lit(0)))
    return both.where(~F.coalesce(F.expr(must) if isinstance(must, str) else must, F.lit(False)))
