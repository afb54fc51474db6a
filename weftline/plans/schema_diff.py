"""Differences of a stored schema from a wanted one, and the statements that close them. Metadata, so plain Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Field, Schema, Table

# Other names of SQL types, and the types that each can be widened to without loss.
SAME = {
    "string": "text", "number": "numeric", "decimal": "numeric", "float": "numeric", "int": "integer", "reference": "uuid", "int4": "integer", "int8": "bigint", "int2": "smallint",
    "float4": "real", "float8": "double precision", "bool": "boolean", "timestamp with time zone": "timestamptz", "timestamp": "timestamptz", "timestamp without time zone": "timestamp",
    "serial4": "serial", "serial8": "bigserial", "long": "bigint", "character": "char",
}
WIDER = {"smallint": {"integer", "bigint", "numeric"}, "integer": {"bigint", "numeric"}, "real": {"double precision", "numeric"}, "varchar": {"text"}, "char": {"varchar", "text"}}
# SQL types of the field types.
SQL_TYPES = {
    "string": "text", "symbol": "text", "regex": "text", "integer": "integer", "long": "bigint", "number": "numeric", "float": "double precision", "decimal": "numeric", "boolean": "boolean", "date": "date",
    "timestamp": "timestamp", "timestamptz": "timestamptz", "object": "jsonb", "json": "jsonb", "map": "jsonb", "uuid": "uuid", "reference": "uuid", "objectid": "varchar(24)", "geopoint": "jsonb", "binary": "bytea", "bytes": "bytea",
}


def sql_type(f: Field) -> str:
    if f.isSerial:
        return "bigserial" if f.type == "long" else "serial"
    if f.rawType:
        return f.rawType.lower()
    if f.type in ("array", "set"):
        return f"{SQL_TYPES.get(f.arrayItemType or 'string', 'text')}[]"
    if f.type == "string" and f.constraints.maxLength:
        return f"varchar({f.constraints.maxLength})"
    return SQL_TYPES.get(f.type, "text")


def normal_type(name: str) -> str:
    low = re.sub(r"\s+", " ", name.strip().lower())
    low = re.sub(r"^character varying", "varchar", low)
    base, _, size = low.partition("(")
    base = base.strip()
    return f"{SAME.get(base, base)}({size}" if size else SAME.get(low, low)


def size_of(kind: str) -> int:
    found = re.search(r"\((\d+)", kind)
    return int(found[1]) if found else 0


def is_destructive(old: str, new: str) -> bool:
    """Whether a change of type may lose values: false for equal types and widenings."""
    a, b = normal_type(old), normal_type(new)
    base_a, base_b = a.split("(")[0], b.split("(")[0]
    if a == b or base_b in WIDER.get(base_a, ()):
        return False
    if base_a == base_b == "varchar":
        return 0 < size_of(b) and (size_of(a) == 0 or size_of(b) < size_of(a))
    return True


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    primaryKey: bool = False
    references: str | None = None


def column(f: Field) -> Column:
    return Column(f.name, sql_type(f), not (f.required or f.primaryKey), None if f.default is None else str(f.default), f.primaryKey, f.references)


Snapshot = dict[str, dict[str, Column]]


def snapshot(schema: Schema) -> Snapshot:
    return {(f"{t.schema}.{t.name}" if t.schema else t.name): {f.name: column(f) for f in t.fields} for t in schema.tables}


def snapshot_of(frames: dict[str, DataFrame | T.StructType]) -> Snapshot:
    """Of stored tables, from their schemas alone."""
    return snapshot(Schema([Table.of(n, x if isinstance(x, T.StructType) else x.schema) for n, x in frames.items()]))


def snapshot_frame(spark: SparkSession, of: Snapshot) -> DataFrame:
    rows = [(t, c.name, c.type, c.nullable, c.default) for t, cols in of.items() for c in cols.values()]
    return spark.createDataFrame(rows, "table string, name string, type string, nullable boolean, default string")


def diff_frame(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same comparison over tables of columns, for catalogues too large for a driver: a full outer join."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, (F.lower(F.col("a.table")) == F.lower(F.col("b.table"))) & (F.col("a.name") == F.col("b.name")), "full_outer")
    changed = ~(F.col("a.type").eqNullSafe(F.col("b.type")) & F.col("a.nullable").eqNullSafe(F.col("b.nullable")) & F.col("a.default").eqNullSafe(F.col("b.default")))
    kind = F.when(F.col("a.name").isNull(), "added").when(F.col("b.name").isNull(), "removed").when(changed, "changed")
    return both.select(F.coalesce("a.table", "b.table").alias("table"), F.coalesce("a.name", "b.name").alias("name"), kind.alias("change"), F.col("a.type").alias("old_type"), F.col("b.type").alias("new_type")).where("change is not null")


@dataclass
class Change:
    old: Column
    new: Column

    @property
    def type_changed(self) -> bool:
        return normal_type(self.old.type) != normal_type(self.new.type)

    @property
    def destructive(self) -> bool:
        return self.type_changed and is_destructive(self.old.type, self.new.type) or self.old.nullable and not self.new.nullable


@dataclass
class Modified:
    table: str
    added: list[Column] = field(default_factory=list)
    removed: list[Column] = field(default_factory=list)
    changed: list[Change] = field(default_factory=list)


@dataclass
class Diff:
    added: dict[str, list[Column]] = field(default_factory=dict)
    removed: dict[str, list[Column]] = field(default_factory=dict)
    modified: list[Modified] = field(default_factory=list)

    @property
    def total(self) -> int:
        return len(self.added) + len(self.removed) + sum(len(m.added) + len(m.removed) + len(m.changed) for m in self.modified)

    @property
    def destructive(self) -> int:
        return len(self.removed) + sum(len(m.removed) + sum(c.destructive for c in m.changed) for m in self.modified)

    def summary(self) -> dict[str, int]:
        return {"addedTables": len(self.added), "removedTables": len(self.removed), "modifiedTables": len(self.modified), "totalChanges": self.total, "destructiveChanges": self.destructive}


def bare(name: str) -> str:
    return name.split(".")[-1].lower()


def diff(old: Snapshot | None, new: Schema | Snapshot, mode: str = "additive", drop_tables: bool | None = None, drop_columns: bool | None = None) -> Diff:
    """Without an old snapshot there is no difference. Drops are found only in mode full, or where they are allowed one by one."""
    out = Diff()
    if old is None:
        return out
    drop_tables, drop_columns = (mode == "full" if x is None else x for x in (drop_tables, drop_columns))
    wanted = snapshot(new) if isinstance(new, Schema) else new
    by_name = {bare(n): (n, cols) for n, cols in old.items()}
    for name, cols in wanted.items():
        if bare(name) not in by_name:
            out.added[name] = list(cols.values())
            continue
        have, m = by_name[bare(name)][1], Modified(by_name[bare(name)][0])
        m.added = [c for n, c in cols.items() if n not in have]
        m.removed = [c for n, c in have.items() if n not in cols] if drop_columns else []
        for n, c in cols.items():
            if n in have and (normal_type(have[n].type) != normal_type(c.type) or have[n].nullable != c.nullable or have[n].default != c.default):
                m.changed.append(Change(have[n], c))
        if m.added or m.removed or m.changed:
            out.modified.append(m)
    if drop_tables:
        own = {bare(n) for n in wanted}
        out.removed = {n: list(c.values()) for n, c in old.items() if bare(n) not in own}
    return out


@dataclass
class Statement:
    sql: str
    kind: str
    table: str
    destructive: bool = False


def quoted(name: str, dialect: str) -> str:
    q = "`" if dialect == "spark" else '"'
    return ".".join(f"{q}{p}{q}" for p in name.split("."))


def spark_type(kind: str) -> str:
    low = normal_type(kind)
    base = low.split("(")[0]
    if low.endswith("[]"):
        return f"ARRAY<{spark_type(low[:-2])}>"
    known = {"text": "STRING", "varchar": "STRING", "char": "STRING", "uuid": "STRING", "jsonb": "STRING", "json": "STRING", "integer": "INT", "serial": "INT", "bigint": "BIGINT", "bigserial": "BIGINT", "smallint": "SMALLINT", "real": "FLOAT", "double precision": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "bytea": "BINARY"}
    return (f"DECIMAL{low[len('numeric'):]}" if "(" in low else "DECIMAL(38,10)") if base == "numeric" else known.get(base, "STRING")


def ddl(d: Diff, dialect: str = "postgresql") -> list[Statement]:
    """New tables, new columns, changed columns, dropped columns, dropped tables. dialect: postgresql or spark."""
    kind = spark_type if dialect == "spark" else (lambda x: x)
    q = lambda n: quoted(n, dialect)

    def defined(c: Column) -> str:
        return f"{q(c.name)} {kind(c.type)}{'' if c.nullable else ' NOT NULL'}{f' DEFAULT {c.default}' if c.default is not None else ''}"

    out = []
    for name, cols in d.added.items():
        parts = [defined(c) for c in cols]
        keys = [q(c.name) for c in cols if c.primaryKey]
        if keys and dialect != "spark":
            parts.append(f"PRIMARY KEY ({', '.join(keys)})")
        out.append(Statement(f"CREATE TABLE {q(name)} (\n  " + ",\n  ".join(parts) + "\n);", "CREATE_TABLE", name))
    for m in d.modified:
        out += [Statement(f"ALTER TABLE {q(m.table)} ADD COLUMN {defined(c)};", "ADD_COLUMN", m.table) for c in m.added]
    for m in d.modified:
        for c in m.changed:
            alter = f"ALTER TABLE {q(m.table)} ALTER COLUMN {q(c.new.name)}"
            if c.type_changed:
                lossy = is_destructive(c.old.type, c.new.type)
                using = "" if lossy or dialect == "spark" else f" USING {q(c.new.name)}::{c.new.type}"
                out.append(Statement(f"{alter} TYPE {kind(c.new.type)}{using};", "ALTER_COLUMN", m.table, lossy))
            if c.old.nullable != c.new.nullable:
                out.append(Statement(f"{alter} {'DROP' if c.new.nullable else 'SET'} NOT NULL;", "ALTER_COLUMN", m.table, not c.new.nullable))
            if c.old.default != c.new.default:
                out.append(Statement(f"{alter} " + (f"SET DEFAULT {c.new.default};" if c.new.default is not None else "DROP DEFAULT;"), "ALTER_COLUMN", m.table))
    for m in d.modified:
        out += [Statement(f"ALTER TABLE {q(m.table)} DROP COLUMN {q(c.name)};", "DROP_COLUMN", m.table, True) for c in m.removed]
    out += [Statement(f"DROP TABLE {q(n)}{'' if dialect == 'spark' else ' CASCADE'};", "DROP_TABLE", n, True) for n in d.removed]
    return out


def foreign_keys(schema: Schema) -> list[str]:
    """Statements that add the references of many-to-one and one-to-one relations."""
    out = []
    for r in schema.relations:
        child, parent = schema.table(r.fromTable), schema.table(r.toTable)
        if not child or not parent or r.type in ("many-to-many", "N:M"):
            continue
        mine, theirs = r.fromFields or [r.fromField], r.toFields or [r.toField or (parent.keys()[0].name if parent.keys() else "id")]
        if r.type in ("one-to-many", "1:N"):
            child, parent, mine, theirs = parent, child, theirs, mine
        if all(mine):
            names = lambda xs: ", ".join(f'"{x}"' for x in xs)
            out.append(f'ALTER TABLE "{child.name}" ADD CONSTRAINT "fk_{child.name}_{"_".join(mine)}" FOREIGN KEY ({names(mine)}) REFERENCES "{parent.name}" ({names(theirs)}) ON DELETE SET NULL;')
    return out


def execute(statements: list[Statement], run: Callable[[str], object], allow_destructive: bool = False) -> dict:
    """Runs statement after statement; stops at the first that fails. Spark has no transaction over several, so what ran stays."""
    done = 0
    for s in statements:
        if s.destructive and not allow_destructive:
            return {"ok": False, "executed": done, "failedAt": s.sql, "error": "destructive; pass allow_destructive=True"}
        try:
            run(s.sql.rstrip(";"))
        except Exception as e:  # noqa: BLE001
            return {"ok": False, "executed": done, "failedAt": s.sql, "error": str(e)}
        done += 1
    return {"ok": True, "executed": done, "failedAt": None, "error": None}


CHECKS = [
    (re.compile(r"(?:char_)?length\(\(?\"?(\w+)\"?\)?(?:::\w+)?\)\s*(>=|<=|>|<)\s*(\d+)", re.I), "length"),
    (re.compile(r"\(?\"?(\w+)\"?\)?(?:::[\w ]+)?\s+between\s+\(?(-?[\d.]+)\)?\s+and\s+\(?(-?[\d.]+)", re.I), "between"),
    (re.compile(r"\(?\"?(?<!:)\b(\w+)\"?\)?(?:::[\w ]+?)?\)?\s*(?:=\s*ANY\s*\(+ARRAY\[|in\s*\()([^\])]*)[\])]", re.I), "in"),
    (re.compile(r"\(?\"?(\w+)\"?\)?(?:::[\w ]+)?\s*(>=|<=|>|<)\s*\(?'?(-?\d[\d.]*)'?", re.I), "bound"),
    (re.compile(r"\"?([a-zA-Z_]\w*)\"?\s*(>=|<=|>|<)\s*\"?([a-zA-Z_]\w*)\"?", re.I), "columns"),
]


def parse_check(text: str) -> dict[str, dict]:
    """field -> constraints that a CHECK expression implies. An open bound of whole numbers moves by one; other open bounds stay as they are."""
    out: dict[str, dict] = {}
    for part in re.split(r"\s+and\s+(?![^()]*between)(?!\(?-?[\d.]+\)?(?:::\w+)?\s*(?:\)|$))", text, flags=re.I):
        for regex, kind in CHECKS:
            m = regex.search(part)
            if not m:
                continue
            own = out.setdefault(m[1], {})
            if kind == "length":
                n = int(m[3]) + {">": 1, "<": -1}.get(m[2], 0)
                own["minLength" if m[2][0] == ">" else "maxLength"] = n
            elif kind == "between":
                own |= {"min": float(m[2]), "max": float(m[3])}
            elif kind == "in":
                own["enum"] = [x.strip().split("::")[0].strip("'\" ") for x in m[2].split(",") if x.strip()]
            elif kind == "bound":
                n = float(m[3])
                own["min" if m[2][0] == ">" else "max"] = n + {">": 1, "<": -1}.get(m[2], 0) if n.is_integer() and "." not in m[3] else n
            else:
                own[{">": "gtColumn", ">=": "minColumn", "<": "ltColumn", "<=": "maxColumn"}[m[2]]] = m[3]
            break
    return {k: v for k, v in out.items() if v}
