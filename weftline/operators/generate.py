"""Rows from a schema: every column is an expression of (seed, table, field, row index), so no row depends on another.

References need no lookup: child i refers to parent i mod N, whose key is computed by the same expression as in the parent's own table.
Output therefore doesn't depend on the partitioning, and any range of rows can be made by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import hashing as H
from ..functions import providers as P
from ..functions.names import singular
from ..plans import depgraph
from ..plans.infer import infer
from ..spec import Field, Relation, Schema, Table, canonical_type

INTEGERS = ("integer", "long", "number", "float", "decimal")
TIMES = ("date", "timestamp", "timestamptz")
NOW_WORDS = ("now", "current_timestamp", "current_date", "getdate", "sysdate", "localtimestamp", "$$now", "utc_timestamp", "today")
UPDATED = ("updated_at", "updatedat", "modified_at", "modifiedat", "last_modified", "lastmodified")
CREATED = ("createdAt", "created_at", "insertedAt", "inserted_at")
DAYS10_MS = 10 * P.DAY_MS
NULL_SHARE = 0.2


# Pieces that are of use by themselves.
def adjust_steps(low=None, above=None, high=None, below=None, floor=None, offset: Column | None = None) -> list[Callable[[Column], Column]]:
    """Steps, in order, that bring a value within other columns' bounds. Null bounds are skipped.

    Numbers: below low it is low + |v|; not above `above` it is that + max(1, |v|); over high or not below `below` it wraps around between
    the floor and the bound. Times (offset: milliseconds): the bound plus or minus the offset.
    """
    floor = F.lit(0.0) if floor is None else floor

    def wrapped(v: Column, bound: Column, else_: Column) -> Column:
        return F.when(bound > floor, floor + F.abs(v) % F.nullif(bound - floor, F.lit(0))).otherwise(else_)

    def step(bound, breaks, number, time):
        return lambda v: F.when(F.coalesce(breaks(v, bound), F.lit(False)), time(bound) if offset is not None else number(v, bound)).otherwise(v)

    later, earlier = (lambda b: b + offset), (lambda b: b - offset)
    out = []
    if low is not None:
        out.append(step(low, lambda v, b: v < b, lambda v, b: b + F.abs(v), later))
    if above is not None:
        out.append(step(above, lambda v, b: v <= b, lambda v, b: b + F.greatest(F.lit(1.0), F.abs(v)), later))
    if high is not None:
        out.append(step(high, lambda v, b: v > b, lambda v, b: wrapped(v, b, b), earlier))
    if below is not None:
        out.append(step(below, lambda v, b: v >= b, lambda v, b: wrapped(v, b, b - 1), earlier))
    return out


def adjust(value: Column, **bounds) -> Column:
    for step in adjust_steps(**bounds):
        value = step(value)
    return value


def unique_text(value: Column, index: Column, longest: int | None = None) -> Column:
    """A value with _<index> at its end, or before the @ of an address, cut first so that the suffix fits."""
    suffix = F.concat(F.lit("_"), index.cast("string"))
    local, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.concat(F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))
    mail = F.concat(F.left(local, F.greatest(F.lit(1), F.lit(longest or 254) - F.length(suffix) - F.length(domain))), suffix, domain)
    plain = F.concat(F.left(value, F.greatest(F.lit(1), F.lit(longest or 255) - F.length(suffix))), suffix)
    return F.when(F.contains(value, F.lit("@")), mail).otherwise(plain)


def fit_text(value: Column, shortest: int | None = None, longest: int | None = 255) -> Column:
    """Cut to the longest, or filled up with the word extra to exactly the shortest length."""
    out = F.left(value, F.lit(longest)) if longest is not None else value
    if shortest:
        out = F.when(F.length(out) < shortest, F.left(F.concat(out, F.lit(" extra" * (shortest // 6 + 1))), F.lit(shortest))).otherwise(out)
    return out


def shard_ranges(df: DataFrame, count: str, workers: int) -> DataFrame:
    """df with worker, start and n: contiguous ranges of `count` rows, the first ones larger by the remainder, empty ones left out."""
    size, rest, w = F.expr(f"{count} div {workers}"), F.col(count) % workers, F.col("worker")
    out = df.withColumn("worker", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(workers - 1).cast("long"))))
    return out.withColumns({"start": w * size + F.least(w, rest), "n": size + (w < rest).cast("long")}).where("n > 0")


@dataclass
class Config:
    """counts: rows of each table. nullShare, distributions and corpora change how values are drawn."""

    counts: dict[str, int]
    seed: object = 42
    as_of: str = "2024-01-01 00:00:00"
    start: dict[str, int] = field(default_factory=dict)
    partitions: int | None = None
    corpora: dict[str, list[str]] = field(default_factory=dict)
    distributions: dict[str, dict] = field(default_factory=dict)
    """'table.field' -> {"kind": "normal" | "zipf" | "exponential" | "uniform", ...its parameters}"""
    on_progress: Callable[[str, int], None] | None = None


@dataclass
class Generator:
    schema: Schema
    config: Config

    def __post_init__(self) -> None:
        self.warnings: list[str] = []
        known = set(self.config.counts)
        self.relations = [r for r in self.schema.relations if self._table(r.fromTable) in known and self._table(r.toTable) in known]
        for r in self.relations:
            self._inject(r)

    def _table(self, name: str) -> str | None:
        own = self.schema.table(name)
        return own.name if own else None

    def _inject(self, r: Relation) -> None:
        """Adds a foreign key's field if the child lacks it."""
        child, parent = self.ends(r)
        if r.fromFields or r.type in ("many-to-many", "N:M"):
            return
        name = self.reference_name(r, child, parent)
        if not child.field(name):
            if not parent.keys():
                self.warnings.append(f"No primary key found for {parent.name}; {child.name}.{name} refers to row numbers")
            kind = parent.keys()[0].type if parent.keys() else "integer"
            child.fields.append(Field(name, kind, foreignKey=True, references=parent.name))

    def ends(self, r: Relation) -> tuple[Table, Table]:
        """Child and parent."""
        a, b = self.schema.table(r.fromTable), self.schema.table(r.toTable)
        return (b, a) if r.type in ("one-to-many", "1:N") else (a, b)

    def reference_name(self, r: Relation, child: Table, parent: Table) -> str:
        named = r.toField if r.type in ("one-to-many", "1:N") else r.fromField
        if named:
            return named
        one = singular(parent.name)
        own = [f.name for f in child.fields]
        for name in (f"{one}Id", f"{one}_id", f"{parent.name}Id", f"{parent.name}_id", one):
            if name in own:
                return name
        return next((f.name for f in child.fields if f.foreignKey and (f.references or "").split(".")[0] == parent.name), f"{one}Id")

    def count(self, table: str) -> int:
        return self.config.counts.get(table, 0)

    def targets(self, table: Table) -> dict[str, tuple[Table, str | None, Relation | None]]:
        """field -> the table and column that it refers to."""
        out: dict[str, tuple[Table, str | None, Relation | None]] = {}
        for r in self.relations:
            if r.type in ("many-to-many", "N:M"):
                if r.fromField and self.schema.table(r.fromTable) is table:
                    out[r.fromField] = (self.schema.table(r.toTable), None, r)
                continue
            child, parent = self.ends(r)
            if child is table:
                mine, theirs = (r.toFields, r.fromFields) if r.type in ("one-to-many", "1:N") else (r.fromFields, r.toFields)
                if mine:
                    out |= {a: (parent, b, r) for a, b in zip(mine, theirs, strict=True)}
                else:
                    out[self.reference_name(r, child, parent)] = (parent, r.fromField if r.type in ("one-to-many", "1:N") else r.toField, r)
        for f in table.fields:
            if f.name not in out and (f.references or f.foreignKey or f.type == "reference"):
                name, _, column = (f.references or self.stem_target(f.name) or "").partition(".")
                parent = self.schema.table(name or None)
                if parent and parent.name in self.config.counts:
                    out[f.name] = (parent, column or None, None)
        return out

    def stem_target(self, name: str) -> str | None:
        low = name.lower()
        for end in ("_id", "_uuid", "_key", "_fk", "id"):
            if low.endswith(end):
                base = low[: -len(end)]
                own = (base, f"{base}s", f"{base}es", f"{base[:-1]}ies" if base.endswith("y") else base)
                return next((t.name for t in self.schema.tables if t.name.lower() in own), None)
        return None

    def key(self, table: Table, f: Field, index: Column, seen: tuple = ()) -> Column:
        """The value of a key field in a row; the same for the row itself and for all that refer to it."""
        target = self.targets(table).get(f.name)
        if target and (table.name, f.name) not in seen:
            return self.reference(target[0], target[1], table, index, (*seen, (table.name, f.name)))
        if f.type in INTEGERS:
            value = index + F.lit(self.config.start.get(table.name, 0) + 1)
            return value.cast(f.spark_type())
        digits = H.hash_digits(self.config.seed, table.name, f.name, index + F.lit(self.config.start.get(table.name, 0)))
        return H.dashed(digits) if f.type == "uuid" else F.substring(digits, 1, 24)

    def reference(self, parent: Table, column: str | None, child: Table, index: Column, seen: tuple = ()) -> Column:
        """Row i refers to row i mod N; in its own table to the row a tenth down, row 0 to itself."""
        at = F.floor(index / 10).cast("long") if parent is child else F.pmod(index, F.lit(max(1, self.count(parent.name))))
        f = parent.field(column) if column else (parent.keys() or [None])[0]
        if f is None:
            return at + 1
        if f.primaryKey:
            return self.key(parent, f, at, seen)
        return self.value(parent, f, at, {})

    def value(self, table: Table, f: Field, index: Column, built: dict[str, Column]) -> Column:
        """A field that is no key. built: columns that are there already."""
        c = P.Context(self.config.seed, table.name, f.name, index, self.config.as_of, self.config.corpora)
        out = self.drawn(table, f, c)
        if f.default is not None:
            now = isinstance(f.default, str) and f.default.lower().startswith(NOW_WORDS)
            out = F.lit(self.config.as_of if now else f.default).cast(f.spark_type())
        if not f.required and not f.primaryKey:
            share = NULL_SHARE if f.constraints.nullPercentage is None else f.constraints.nullPercentage / 100
            if share > 0:
                out = F.when(c.u(101) >= share, out)
        return out

    def drawn(self, table: Table, f: Field, c: P.Context) -> Column:
        k, kind = f.constraints, f.type
        special = self.config.distributions.get(f"{table.name}.{f.name}")
        if k.enum:
            return D.pick(c.u(), k.enum).cast(f.spark_type())
        if kind == "boolean":
            rule = P.FLAG.get(infer(f.name, table.name))
            return rule(c) if rule else c.u() > 0.5
        if kind in INTEGERS:
            if k.unique:
                return (c.index + F.lit(self.config.start.get(table.name, 0) + 1)).cast(f.spark_type())
            out = self.number(f, c, special, P.NUMBER.get(infer(f.name, table.name)))
            return (F.round(out) if kind in ("integer", "long") else out).cast(f.spark_type())
        if kind in TIMES:
            return self.times(f, c).cast(f.spark_type())
        if kind in ("object",):
            parts = f.objectFields or [Field("id", "objectid", True), Field("value", "string", True), Field("createdAt", "timestamp", True)]
            return F.struct(*[self.drawn(table, p, P.Context(c.seed, c.table, f"{f.name}.{p.name}", c.index, c.as_of, c.corpora)).alias(p.name) for p in parts])
        if kind == "json":
            return F.to_json(F.struct(c.pick("words", 1).alias("value"), D.integer(c.u(2), 0, 999).alias("id")))
        if kind == "map":
            return F.create_map(F.lit("id"), F.substring(c.digits(), 1, 8), F.lit("value"), c.pick("words", 1))
        if kind in ("array", "set"):
            low, high = k.minItems if k.minItems is not None else 1, k.maxItems if k.maxItems is not None else 5
            n = D.integer(c.u(), low, max(low, high)).cast("int")
            item = canonical_type(f.arrayItemType or "string")

            def one(i: Column) -> Column:
                u = H.uniform(c.seed, c.table, c.name, c.index, i, draw=7)
                if item in ("integer", "long"):
                    return D.integer(u, 0, 99).cast("int" if item == "integer" else "long")
                if item in ("number", "float", "decimal"):
                    return F.round(u * 100.0, 1)
                if item == "boolean":
                    return u > 0.5
                return D.pick(u, c.listed("words"))

            out = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one) if low > 0 else F.slice(F.transform(F.sequence(F.lit(1), F.lit(max(1, high))), one), 1, n)
            return (F.array_distinct(out) if kind == "set" or k.uniqueItems else out).cast(f.spark_type())
        if kind == "geopoint":
            return F.struct(D.number(c.u(1), -90, 90).alias("lat"), D.number(c.u(2), -180, 180).alias("lng"))
        if kind in ("binary", "bytes"):
            return F.unhex(F.substring(c.digits(), 1, 16))
        if kind in ("null", "undefined"):
            return F.lit(None).cast("string")
        if kind in ("uuid", "objectid", "reference"):
            return P.TEXT["uuid"](c) if kind != "objectid" else F.substring(c.digits(), 1, 24)
        return self.text(table, f, c)

    def number(self, f: Field, c: P.Context, special: dict | None, rule) -> Column:
        k = f.constraints
        low, high = k.min, k.max
        if special:
            kind = special.get("kind", "uniform")
            if kind == "normal":
                out = D.normal(c.u(0), c.u(1), special.get("mean", 0.0), special.get("sd", 1.0))
            elif kind == "exponential":
                out = D.exponential(c.u(), special.get("rate", 1.0))
            elif kind == "zipf":
                out = D.zipf(c.u(), special.get("n", 100), special.get("s", 1.0))
            else:
                out = D.number(c.u(), low if low is not None else 0, high if high is not None else 10_000)
        elif rule:
            out = rule(c)
        elif f.type in ("integer", "long"):
            out = D.integer(c.u(), int(low) if low is not None else 0, int(high) if high is not None else max(10_000, int(low or 0)))
        else:
            out = D.number(c.u(), low if low is not None else 0, high if high is not None else max(10_000, low or 0))
        out = out.cast("double")
        if k.multipleOf:
            out = F.round(out / float(k.multipleOf)) * F.lit(float(k.multipleOf))
        return D.clamp(out, None if low is None else float(low), None if high is None else float(high))

    def times(self, f: Field, c: P.Context) -> Column:
        k = f.constraints
        if k.startDate or k.endDate:
            low = F.unix_millis(F.lit(k.startDate or "2000-01-01").cast("timestamp"))
            high = F.unix_millis(F.lit(k.endDate or self.config.as_of).cast("timestamp"))
            return F.timestamp_millis(low + F.floor(c.u() * (high - low)).cast("long"))
        return F.timestamp_millis(c.ago(365))

    def text(self, table: Table, f: Field, c: P.Context) -> Column:
        k = f.constraints
        out = P.TEXT.get(infer(f.name, table.name), P.TEXT["word"])(c)
        if k.trim:
            out = F.trim(out)
        out = F.lower(out) if k.lowercase else F.upper(out) if k.uppercase else out
        if k.unique:
            out = unique_text(out, c.index + F.lit(self.config.start.get(table.name, 0)), k.maxLength)
        return fit_text(out, k.minLength, k.maxLength if k.maxLength is not None else 255)

    def frame(self, spark: SparkSession, name: str, first: int = 0, n: int | None = None) -> DataFrame:
        """Rows first .. first + n - 1 of a table; all of them by default."""
        table = self.schema.table(name)
        total = self.count(table.name)
        last = total if n is None else first + n
        parts = self.config.partitions or max(1, min(10_000, (last - first) // 500_000 + 1))
        return self.project(spark.range(first, last, 1, parts).withColumnRenamed("id", "_row"), table.name)

    def project(self, rows: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """A table's row for each row number (_row) of a frame or stream, and the columns to keep."""
        table = self.schema.table(name)
        index, targets = F.col("_row"), self.targets(table)
        plain, later = {}, []
        for column in depgraph.column_order(table):
            f = table.field(column)
            if f.primaryKey:
                plain[column] = self.key(table, f, index)
            elif f.name in targets:
                plain[column] = self.referring(table, f, targets[f.name], index)
            else:
                plain[column] = self.value(table, f, index, plain)
                k = f.constraints
                bounds = {"low": k.minColumn, "above": k.gtColumn, "high": k.maxColumn, "below": k.ltColumn}
                bounds = {b: x for b, x in bounds.items() if x and table.field(x)}
                updated = f.name.lower() in UPDATED and next((x for x in CREATED if table.field(x)), None)
                if bounds or updated:
                    later.append((f, bounds, updated))
        df = rows.select("_row", *keep, *[v.alias(x) for x, v in plain.items()])
        for f, bounds, updated in later:
            df = self.bounded(df, table, f, bounds, updated)
        return df.select(*keep, *[F.col(f.name).cast(f.spark_type()).alias(f.name) for f in table.fields])

    def referring(self, table: Table, f: Field, target: tuple, index: Column) -> Column:
        parent, column, r = target
        if r and r.type in ("many-to-many", "N:M"):
            low, high = r.minReferences or 1, r.maxReferences or 3
            u = lambda d, *more: H.uniform(self.config.seed, table.name, f.name, index, *more, draw=d)
            n, size = D.integer(u(0), low, high).cast("int"), max(1, self.count(parent.name))
            own = parent.keys()[0]
            return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: self.key(parent, own, D.integer(u(1, i), 0, size - 1))))
        value = self.reference(parent, column, table, index)
        if parent is table and not f.required:
            value = F.when(index > 0, value)
        return value

    def bounded(self, df: DataFrame, table: Table, f: Field, bounds: dict[str, str], updated: str | None) -> DataFrame:
        """A column brought within other columns' bounds, one projection a step."""
        c = P.Context(self.config.seed, table.name, f.name, F.col("_row"), self.config.as_of)
        if updated:
            ms = F.unix_millis(F.col(updated).try_cast("timestamp")) + F.floor(c.u(50) * float(DAYS10_MS)).cast("long")
            new = F.timestamp_millis(ms) if f.type in TIMES else P.iso(ms)
            df = df.withColumn(f.name, F.when(F.col(f.name).isNotNull() & ms.isNotNull(), new.cast(df.schema[f.name].dataType)).otherwise(F.col(f.name)))
        if not bounds or f.type not in (*INTEGERS, *TIMES):
            return df
        kind = df.schema[f.name].dataType
        as_time = f.type in TIMES
        number = (lambda x: F.unix_millis(x.cast("timestamp"))) if as_time else (lambda x: x.cast("double"))
        offset = F.lit(60_000) + F.floor(c.u(51) * float(DAYS10_MS)).cast("long") if as_time else None
        df = df.withColumn("_v", number(F.col(f.name)))
        for step in adjust_steps(**{b: number(F.col(x)) for b, x in bounds.items()}, floor=F.lit(float(f.constraints.min or 0)), offset=offset):
            df = df.withColumn("_v", step(F.col("_v")))
        day = F.col("_v")
        return df.withColumn(f.name, (F.timestamp_millis(day.cast("long")) if as_time else day).cast(kind)).drop("_v")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All configured tables, parents first."""
        return {n: self.frame(spark, n) for n in depgraph.table_order(self.schema) if n in self.config.counts}

    def write(self, spark: SparkSession, sink: Callable[[str, DataFrame], None], threads: int = 4) -> list[dict]:
        """Hands the tables to a sink, level by level, the tables of a level side by side. Errors are collected, not raised.

        Each result has the table's rows, seconds and rows a second, and as of then the rows of all tables, rows a second overall and the seconds
        that the rest should take at that pace (None before the first row).
        """
        out: list[dict] = []
        began, done, lock = time.monotonic(), [0], Lock()
        total = sum(self.config.counts.values())

        def one(name: str) -> dict:
            start = time.monotonic()
            try:
                sink(name, self.frame(spark, name))
                found = {"table": name, "rows": self.count(name), "error": None}
            except Exception as e:  # noqa: BLE001
                found = {"table": name, "rows": 0, "error": str(e)}
            now = time.monotonic()
            with lock:
                done[0] += found["rows"]
                pace = done[0] / max(now - began, 1e-9)
                found |= {"seconds": now - start, "rows_per_sec": found["rows"] / max(now - start, 1e-9), "total_rows": done[0], "total_rows_per_sec": pace, "seconds_left": (total - done[0]) / pace if pace else None}
            if self.config.on_progress:
                self.config.on_progress(name, found["rows"])
            return found

        with ThreadPoolExecutor(threads) as pool:
            for level in depgraph.levels(depgraph.table_graph(self.schema))[0]:
                out += pool.map(one, [n for n in level if n in self.config.counts])
        return out
