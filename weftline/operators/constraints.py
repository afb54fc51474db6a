"""Validation rules as boolean columns, evaluated together in one pass.

A rule's `broken` column is true where a row violates it and null or false elsewhere: a null value breaks only rules that ask for a
value. Rules over whole tables (uniqueness, null rates) are in integrity.py.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Table

# What counts as an address.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
URL = r"^(?i)https?://[^\s/$.?#].[^\s]*$"
DAY = 86400

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


@dataclass
class Rule:
    name: str
    field: str
    broken: Column
    message: str = ""
    severity: str = "error"
    retryable: bool = True
    priority: int = 0
    fix: Column | None = None
    """the value that a broken one is replaced by"""


def number_range(name: str, low=None, high=None, exclusive: bool = False) -> Rule:
    """Broken: not a number, or outside the bounds. Corrected to the nearest bound."""
    v = F.col(name)
    n = v.try_cast("double")
    outside = F.lit(False)
    if low is not None:
        outside |= (n <= low) if exclusive else (n < low)
    if high is not None:
        outside |= (n >= high) if exclusive else (n > high)
    fix = n
    if low is not None:
        fix = F.greatest(fix, F.lit(float(low)))
    if high is not None:
        fix = F.least(fix, F.lit(float(high)))
    ends = ("(", ")") if exclusive else ("[", "]")
    return Rule(f"range:{name}", name, v.isNotNull() & F.coalesce(outside | n.isNull(), F.lit(False)), f"{name} must be in {ends[0]}{low}, {high}{ends[1]}", fix=None if exclusive else fix)


def length(name: str, low: int | None = None, high: int | None = None) -> Rule:
    n = F.length(F.col(name))
    broken = F.lit(False)
    if low is not None:
        broken |= n < low
    if high is not None:
        broken |= n > high
    return Rule(f"length:{name}", name, F.col(name).isNotNull() & broken, f"{name} must have {low} to {high} characters", fix=F.substring(F.col(name), 1, high) if high is not None and low is None else None)


def pattern(name: str, regex: str, kind: str = "pattern") -> Rule:
    """A search, not a full match."""
    return Rule(f"{kind}:{name}", name, ~F.col(name).rlike(regex), f"{name} must match {regex}")


def email(name: str) -> Rule:
    return pattern(name, EMAIL, "email")


def url(name: str) -> Rule:
    return pattern(name, URL, "url")


def enum(name: str, values: list) -> Rule:
    return Rule(f"enum:{name}", name, ~F.col(name).isin(values), f"{name} must be one of {values}", retryable=False, fix=F.lit(values[0]) if values else None)


def required(name: str) -> Rule:
    return Rule(f"required:{name}", name, F.col(name).isNull(), f"{name} must be set", retryable=False)


def multiple_of(name: str, step: float) -> Rule:
    n = F.col(name).cast("double") / F.lit(float(step))
    return Rule(f"multipleOf:{name}", name, F.abs(n - F.round(n)) > 1e-9, f"{name} must be a multiple of {step}", fix=F.round(n) * F.lit(float(step)))


def unique_items(name: str) -> Rule:
    return Rule(f"uniqueItems:{name}", name, F.size(F.array_distinct(name)) < F.size(name), f"{name} must not repeat items", fix=F.array_distinct(name))


def compare(name: str, op: str, other) -> Rule:
    """Broken where both are set and the comparison doesn't hold. other: a column's name or a Column."""
    return Rule(f"{op}:{name}", name, ~COMPARE[op](F.col(name), col(other)), f"{name} must be {op} {other}")


def sum_of(name: str, parts: list, tolerance: float = 0.0) -> Rule:
    """Missing parts count 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(col(p).try_cast("double"), F.lit(0.0)) for p in parts])
    return Rule(f"sum_of:{name}", name, F.abs(F.col(name).cast("double") - total) > tolerance, f"{name} must be the sum of its parts", fix=total)


def ratio_of(name: str, top, bottom, tolerance: float = 0.01, scale: float = 1.0, kind: str = "ratio_of") -> Rule:
    """A missing part or a denominator of 0 breaks the rule."""
    value, a, b = F.col(name).try_cast("double"), col(top).try_cast("double"), col(bottom).try_cast("double")
    off = F.abs(value - F.try_divide(a, b) * scale) > tolerance
    return Rule(f"{kind}:{name}", name, F.col(name).isNotNull() & F.coalesce(off, F.lit(True)), f"{name} must be {top} / {bottom}", fix=F.try_divide(a, b) * scale)


def percentage_of(name: str, top, bottom, tolerance: float = 1.0) -> Rule:
    return ratio_of(name, top, bottom, tolerance, 100.0, "percentage_of")


def conditional(name: str, condition: Column, then: Column, otherwise: Column | None = None) -> Rule:
    """Where the condition holds `then` must too; elsewhere `otherwise`, if given."""
    must = F.when(F.coalesce(condition, F.lit(False)), then).otherwise(F.lit(True) if otherwise is None else otherwise)
    return Rule(f"conditional:{name}", name, ~F.coalesce(must, F.lit(False)), f"{name} must fit its condition")


def condition(name: str, op: str, value=None) -> Column:
    """eq, ne, gt, gte, lt, lte, exists, not_exists."""
    if op == "exists":
        return F.col(name).isNotNull()
    if op == "not_exists":
        return F.col(name).isNull()
    return COMPARE[op](F.col(name), F.lit(value))


def mutually_exclusive(name: str, others: list[str]) -> Rule:
    taken = reduce(lambda a, b: a | b, [F.col(o).isNotNull() for o in others])
    return Rule(f"exclusive:{name}", name, F.col(name).isNotNull() & taken, f"{name} excludes {others}")


def temporal(name: str, op: str, reference, amount: int | None = None) -> Rule:
    """before, after, within_days (amount), older_than (amount years). A value that is no time breaks the rule."""
    v, ref = F.col(name).try_cast("timestamp"), (col(reference) if not isinstance(reference, str) or not reference[:4].isdigit() else F.lit(reference)).try_cast("timestamp")
    seconds = F.unix_micros(v) - F.unix_micros(ref)
    must = {
        "before": lambda: v < ref,
        "after": lambda: v > ref,
        "within_days": lambda: F.abs(seconds) <= F.lit((amount or 0) * DAY * 1_000_000),
        "older_than": lambda: v.cast("date") <= F.add_months(ref.cast("date"), -12 * (amount or 0)),
    }[op]()
    return Rule(f"{op}:{name}", name, F.col(name).isNotNull() & ~F.coalesce(must, F.lit(False)), f"{name} must be {op} {reference}")


def custom(rule_name: str, name: str, broken: Column, **more) -> Rule:
    return Rule(rule_name, name, broken, **more)


def from_table(table: Table) -> list[Rule]:
    """The rules that a schema's fields imply row by row. table_report() adds those over whole columns."""
    out: list[Rule] = []
    for f in table.fields:
        c = f.constraints
        if f.required or f.primaryKey:
            out.append(required(f.name))
        if c.min is not None or c.max is not None:
            out.append(number_range(f.name, c.min, c.max))
        if c.minLength is not None or c.maxLength is not None:
            out.append(length(f.name, c.minLength, c.maxLength))
        if c.pattern:
            out.append(pattern(f.name, c.pattern))
        if c.enum:
            out.append(enum(f.name, c.enum))
        if c.multipleOf:
            out.append(multiple_of(f.name, c.multipleOf))
        if c.uniqueItems and f.type in ("array", "set"):
            out.append(unique_items(f.name))
        for other, op in ((c.gtColumn, "gt"), (c.ltColumn, "lt"), (c.minColumn, "gte"), (c.maxColumn, "lte")):
            if other and table.field(other):
                out.append(compare(f.name, op, other))
        if c.unique and not f.primaryKey:
            out.append(custom(f"unique_set:{f.name}", f.name, F.col(f.name).isNull(), message=f"{f.name} must be set, as it must be unique", retryable=False))
        others = [o for o in c.mutuallyExclusive or () if table.field(o)]
        if others:
            out.append(mutually_exclusive(f.name, others))
        if c.startDate:
            out.append(temporal(f.name, "after", F.lit(c.startDate).cast("timestamp") - F.expr("interval 1 microsecond")))
        if c.endDate:
            out.append(temporal(f.name, "before", F.lit(c.endDate).cast("timestamp") + F.expr("interval 1 microsecond")))
    return out


def table_report(df: DataFrame, table: Table) -> DataFrame:
    """rule, checked, violations of all that a schema says of a table: its fields' rules, its keys and unique fields, and null shares (violations
    1 where a field has more nulls than nullPercentage allows, by three standard errors)."""
    from .integrity import null_rates, unique_rules

    out = report(df, from_table(table))
    keys = [f.name for f in table.keys()]
    single = [f.name for f in table.fields if f.constraints.unique or keys == [f.name]]
    if single:
        out = out.unionByName(unique_rules(df, single))
    if len(keys) > 1:
        name = "+".join(keys)
        out = out.unionByName(unique_rules(df.select(F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]), F.to_json(F.struct(*keys))).alias(name)), [name]))
    shares = {f.name: f.constraints.nullPercentage / 100 for f in table.fields if f.constraints.nullPercentage is not None and not f.required and not f.primaryKey}
    if shares:
        most = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("field"))
        rates = null_rates(df, list(shares), 1.0)
        over = F.col("rate") > most + 3 * F.sqrt(most * (1 - most) / F.greatest(F.col("n_rows"), F.lit(1)))
        out = out.unionByName(rates.select(F.concat(F.lit("null_rate:"), "field").alias("rule"), F.col("n_rows").alias("checked"), F.coalesce(over, F.lit(False)).cast("long").alias("violations")))
    return out


@dataclass
class Registry:
    """Named rules, strictest priority first. mode: strict (raise), warn, skip (drop broken rows) or retry (correct them)."""

    rules: dict[str, Rule] = field(default_factory=dict)
    mode: str = "warn"

    def register(self, *rules: Rule) -> Registry:
        self.rules |= {r.name: r for r in rules}
        return self

    def unregister(self, name: str) -> bool:
        return self.rules.pop(name, None) is not None

    def get(self, name: str) -> Rule | None:
        return self.rules.get(name)

    def __contains__(self, name: str) -> bool:
        return name in self.rules

    def clone(self) -> Registry:
        return Registry(dict(self.rules), self.mode)

    def clear(self) -> None:
        self.rules.clear()

    def ordered(self) -> list[Rule]:
        return sorted(self.rules.values(), key=lambda r: -r.priority)

    def stats(self) -> dict[str, int]:
        own = self.rules.values()
        return {"rules": len(own), "fields": len({r.field for r in own}), "retryable": sum(r.retryable for r in own), "errors": sum(r.severity == "error" for r in own)}

    def apply(self, df: DataFrame) -> DataFrame:
        rules = self.ordered()
        if self.mode == "skip":
            return df.where(~any_broken(rules))
        if self.mode == "retry":
            return correct(df, rules)
        if self.mode == "strict" and not df.where(any_broken(rules)).isEmpty():
            raise ValueError("rows break the rules: " + ", ".join(r["rule"] for r in report(df, rules).where("violations > 0").collect()))
        return validate(df, rules)


def any_broken(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(r.broken, F.lit(False)) for r in rules], F.lit(False))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with _violations: a struct (rule, field, value, message, severity, retryable) for each broken rule."""
    found = [F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.lit(r.field).alias("field"), (F.col(r.field) if r.field in df.columns else F.lit(None)).cast("string").alias("value"), F.lit(r.message).alias("message"), F.lit(r.severity).alias("severity"), F.lit(r.retryable).alias("retryable"))) for r in rules]
    return df.withColumn("_violations", F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule:string,field:string,value:string,message:string,severity:string,retryable:boolean>>"))


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, checked, violations for each rule and for all rows that break any ('*'), in one scan with partial sums."""
    named = [*((r.name, r.broken) for r in rules), ("*", any_broken(rules))]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b).alias(f"v{k}") for k, (_, b) in enumerate(named)])
    pairs = ", ".join("'{}', v{}".format(name.replace("'", "\\'"), k) for k, (name, _) in enumerate(named))
    return sums.selectExpr("n as checked", f"stack({len(named)}, {pairs}) as (rule, violations)").select("rule", "checked", "violations")


def correct(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with the values of broken rules that have a fix replaced, one rule after another."""
    for r in rules:
        if r.fix is not None and r.field in df.columns:
            df = df.withColumn(r.field, F.when(r.broken, r.fix.cast(df.schema[r.field].dataType)).otherwise(F.col(r.field)))
    return df
