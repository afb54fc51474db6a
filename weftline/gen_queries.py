"""Generated tables as queries: the Generator makes them, and SQL recomputes every value from the same hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hash_sql as X
from .functions.providers import CORPORA
from .operators import integrity
from .operators.generate import Config, Generator
from .registry import query
from .spec import Constraints, Field, Relation, Schema, Table

SEED = 42
COUNTS = {"shops": 400, "tokens": 150, "visits": 1000, "stays": 900, "slots": 120, "labels": 25, "people": 500}
MS_AS_OF, DAY_MS = 1704067200000, 86_400_000


def key(name: str = "id", kind: str = "integer") -> Field:
    return Field(name, kind, True, primaryKey=True)


def ref(name: str, to: str, kind: str = "integer") -> Field:
    return Field(name, kind, True, foreignKey=True, references=to)


def schema() -> Schema:
    limits = lambda **c: Constraints(**c)
    tables = [
        Table("shops", [
            key(), Field("plan", "string", True, constraints=limits(enum=["free", "pro", "max"])), Field("zeta", "integer", constraints=limits(min=10, max=100, nullPercentage=30)), Field("omega", "number", True, constraints=limits(min=5, max=9)),
            Field("kappa", "integer", True, constraints=limits(unique=True)), Field("opened", "timestamp", True, constraints=limits(startDate="2020-01-01", endDate="2021-01-01")), Field("level", "string", default="new"), Field("alpha", "boolean", True),
            Field("delta", "number", True, constraints=limits(min=0, max=50)), Field("sigma", "number", True, constraints=limits(min=0, max=50, gtColumn="delta")),
        ]),
        Table("tokens", [key("id", "uuid"), Field("oid", "objectid", True), ref("shop_id", "shops"), Field("extra", "uuid", True)]),
        Table("visits", [key(), ref("shop_id", "shops"), ref("token_id", "tokens", "uuid"), Field("created_at", "timestamp", True), Field("updated_at", "timestamp", True)]),
        Table("slots", [Field("day", "integer", True, primaryKey=True, keyIndex=0), Field("room", "string", True, primaryKey=True, keyIndex=1)]),
        Table("stays", [key(), Field("slot_day", "integer", True), Field("slot_room", "string", True), Field("labels", "array")]),
        Table("labels", [key(), Field("tag", "string", True, constraints=limits(enum=["a", "b"]))]),
        Table("people", [key(), Field("full_name", "string", True), Field("email", "string", True), Field("city", "string", True), ref("manager_id", "people")]),
    ]
    relations = [
        Relation("stays", "slots", fromFields=["slot_day", "slot_room"], toFields=["day", "room"]),
        Relation("stays", "labels", "many-to-many", fromField="labels", minReferences=1, maxReferences=3),
    ]
    return Schema(tables, relations)


def generator(**options) -> Generator:
    return Generator(schema(), Config(dict(COUNTS), SEED, **options))


def rows_of(table: str) -> str:
    return f"(SELECT i FROM range({COUNTS[table]}) r(i))"


def u(table: str, field: str, draw: int = 0, index: str = "i") -> str:
    return X.uniform(SEED, table, field, index, draw)


def moment(ms: str) -> str:
    return f"make_timestamp(({ms})::BIGINT * 1000)"


LOW_MS, HIGH_MS = 1577836800000, 1609459200000
DELTA, SIGMA = f"({u('shops', 'delta')} * 50.0)", f"({u('shops', 'sigma')} * 50.0)"
SHOPS_SQL = f"""
SELECT (i + 1)::INT AS id, {X.pick(u("shops", "plan"), ["free", "pro", "max"])} AS plan, CASE WHEN {u("shops", "zeta", 101)} >= 0.3 THEN floor({u("shops", "zeta")} * 91.0)::DOUBLE + 10 END AS zeta,
{u("shops", "omega")} * 4.0 + 5.0 AS omega, (i + 1)::INT AS kappa, {moment(f"{LOW_MS} + floor({u('shops', 'opened')} * {HIGH_MS - LOW_MS}.0)::BIGINT")} AS opened,
CASE WHEN {u("shops", "level", 101)} >= 0.2 THEN 'new' END AS level, {u("shops", "alpha")} > 0.5 AS alpha, {DELTA} AS delta,
CASE WHEN {SIGMA} <= {DELTA} THEN {DELTA} + greatest(1.0, {SIGMA}) ELSE {SIGMA} END AS sigma FROM {rows_of("shops")}"""


@query(SHOPS_SQL)
def g_table(spark, sf_dir):
    """Keys, enums, null shares, bounds, unique numbers, dates, defaults, flags, a column above another."""
    return generator().frame(spark, "shops").withColumn("zeta", F.col("zeta").cast("double"))


@query(SHOPS_SQL)
def g_table_ranges(spark, sf_dir):
    """The same table as ranges of rows, made by themselves and in other partitions."""
    cuts = [0, 7, 150, 150, 399, 400]
    parts = [generator(partitions=k + 1).frame(spark, "shops", a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return reduce(DataFrame.unionByName, parts).withColumn("zeta", F.col("zeta").cast("double"))


@query(f"""
SELECT {X.uuid(SEED, "tokens", "id", "i")} AS id, ({X.digits(SEED, "tokens", "oid", "i")})[1:24] AS oid, (i % {COUNTS["shops"]} + 1)::INT AS shop_id, {X.uuid(SEED, "tokens", "extra", "i")} AS extra FROM {rows_of("tokens")}""")
def g_uuid(spark, sf_dir):
    """uuid and object-id keys as generation makes them."""
    return generator().frame(spark, "tokens")


@query(f"""
SELECT (i + 1)::INT AS id, (i % {COUNTS["shops"]} + 1)::INT AS shop_id, {X.uuid(SEED, "tokens", "id", f"(i % {COUNTS['tokens']})")} AS token_id,
{moment(f"{MS_AS_OF} - floor({u('visits', 'created_at')} * {365 * DAY_MS}.0)::BIGINT")} AS created_at,
{moment(f"{MS_AS_OF} - floor({u('visits', 'created_at')} * {365 * DAY_MS}.0)::BIGINT + floor({u('visits', 'updated_at', 50)} * {10 * DAY_MS}.0)::BIGINT")} AS updated_at FROM {rows_of("visits")}""")
def g_references(spark, sf_dir):
    """Integer and uuid references by row number, and an update after its creation."""
    return generator().frame(spark, "visits")


def slot(field: str, index: str) -> str:
    return f"({index} + 1)::INT" if field == "day" else f"({X.digits(SEED, 'slots', 'room', index)})[1:24]"


AT = f"(i % {COUNTS['slots']})"


@query(f"SELECT (i + 1)::INT AS id, {slot('day', AT)} AS slot_day, {slot('room', AT)} AS slot_room FROM {rows_of('stays')}")
def g_composite(spark, sf_dir):
    """References to a composite key."""
    return generator().frame(spark, "stays").select("id", "slot_day", "slot_room")


def label(k: int) -> str:
    """The k-th label drawn for a stay."""
    drawn = X.of_int(1, X.of_int(k, X.of_long("i", f"{X.of_constants(str(SEED), 'stays', 'labels')}{X.WIDE}")))
    return f"(floor((({drawn}) % {1 << 53}{X.WIDE})::DOUBLE / {float(1 << 53)!r}::DOUBLE * {COUNTS['labels']}.0) + 1)::INT"


N_LABELS = f"(floor({u('stays', 'labels')} * 3.0) + 1)::INT"


@query(" UNION ".join(f"SELECT (i + 1)::INT AS id, {label(k)} AS label FROM {rows_of('stays')} WHERE {N_LABELS} >= {k}" for k in (1, 2, 3)))
def g_m2n(spark, sf_dir):
    """One to three different references of a many-to-many relation."""
    return generator().frame(spark, "stays").select("id", F.explode("labels").alias("label"))


def one_of(table: str, field: str, corpus: str, draw: int = 0) -> str:
    return X.pick(u(table, field, draw), CORPORA[corpus])


@query(f"""
SELECT (i + 1)::INT AS id, {one_of("people", "full_name", "given_names", 1)} || ' ' || {one_of("people", "full_name", "family_names", 2)} AS full_name,
lower({one_of("people", "email", "given_names", 1)}) || '.' || lower({one_of("people", "email", "family_names", 2)}) || CASE WHEN {u("people", "email", 4)} < 0.6 THEN (floor({u("people", "email", 5)} * 999.0) + 1)::INT::VARCHAR ELSE '' END || '@' || {one_of("people", "email", "domains", 3)} AS email,
{one_of("people", "city", "cities")} AS city, (i // 10 + 1)::INT AS manager_id FROM {rows_of("people")}""")
def g_people(spark, sf_dir):
    """Values by the meaning of their fields' names, and references to the table itself."""
    return generator().frame(spark, "people")


CHECKED = [Relation("tokens", "shops", fromField="shop_id", toField="id"), Relation("visits", "shops", fromField="shop_id", toField="id"), Relation("visits", "tokens", fromField="token_id", toField="id"), Relation("stays", "slots", fromFields=["slot_day", "slot_room"], toFields=["day", "room"]), Relation("people", "people", fromField="manager_id", toField="id")]


@query(" UNION ALL ".join(f"SELECT '{r.fromTable}.{'+'.join(r.fromFields or [r.fromField])}' AS relation, '{r.toTable}' AS parent, {COUNTS[r.fromTable]}::BIGINT AS n_checked, 0::BIGINT AS n_null, 0::BIGINT AS n_orphans" for r in CHECKED))
def g_integrity(spark, sf_dir):
    """No generated reference is without its row."""
    return integrity.reference_report(generator().tables(spark), CHECKED)
