"""Schemas as data: tables, typed fields, constraints and relationships, to and from JSON and StructType."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

# Field types and the Spark types that hold them.
TYPES = {
    "string": "string", "symbol": "string", "regex": "string", "integer": "int", "long": "bigint", "number": "double", "float": "double",
    "decimal": "decimal(18,2)", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "object": "struct<id:string,value:string,createdAt:timestamp_ntz>", "json": "string", "map": "map<string,string>", "array": "array<string>",
    "set": "array<string>", "uuid": "string", "objectid": "string", "reference": "string", "geopoint": "struct<lat:double,lng:double>",
    "binary": "binary", "bytes": "binary", "null": "string", "undefined": "string",
}

# Other names of the types.
ALIASES = {
    "int": "integer", "int4": "integer", "smallint": "integer", "serial": "integer", "bigint": "long", "int8": "long", "bigserial": "long", "text": "string",
    "varchar": "string", "char": "string", "str": "string", "bool": "boolean", "double": "float", "real": "float", "double precision": "float", "numeric": "decimal",
    "money": "decimal", "datetime": "timestamp", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "jsonb": "json", "guid": "uuid",
    "oid": "objectid", "dict": "object", "list": "array", "blob": "binary", "bytea": "binary", "point": "geopoint", "email": "string", "url": "string", "enum": "string",
}


def canonical_type(name: str) -> str:
    low = (name or "string").strip().lower()
    bare = low.split("(")[0].strip()
    return low if low in TYPES else ALIASES.get(low) or (bare if bare in TYPES else ALIASES.get(bare, "string"))


@dataclass
class Constraints:
    minLength: int | None = None
    maxLength: int | None = None
    pattern: str | None = None
    enum: list | None = None
    min: float | None = None
    max: float | None = None
    multipleOf: float | None = None
    minItems: int | None = None
    maxItems: int | None = None
    uniqueItems: bool | None = None
    unique: bool | None = None
    sparse: bool | None = None
    immutable: bool | None = None
    index: bool | None = None
    lowercase: bool | None = None
    uppercase: bool | None = None
    trim: bool | None = None
    startDate: str | None = None
    endDate: str | None = None
    nullPercentage: float | None = None
    minColumn: str | None = None
    maxColumn: str | None = None
    gtColumn: str | None = None
    ltColumn: str | None = None
    mutuallyExclusive: list[str] | None = None


@dataclass
class Field:
    name: str
    type: str = "string"
    required: bool = False
    default: Any = None
    constraints: Constraints = field(default_factory=Constraints)
    primaryKey: bool = False
    foreignKey: bool = False
    references: str | None = None
    """table or table.column"""
    rawType: str | None = None
    isSerial: bool = False
    keyIndex: int | None = None
    group: str | None = None
    """fields of one composite foreign key share it"""
    arrayItemType: str | None = None
    objectFields: list[Field] | None = None
    description: str | None = None

    def spark_type(self) -> T.DataType:
        if self.objectFields:
            return T.StructType([f.struct_field() for f in self.objectFields])
        if self.type in ("array", "set") and self.arrayItemType:
            return T.ArrayType(T._parse_datatype_string(TYPES[canonical_type(self.arrayItemType)]))
        if self.rawType and self.rawType.lower().startswith(("decimal(", "numeric(")):
            return T._parse_datatype_string(self.rawType.lower().replace("numeric", "decimal"))
        return T._parse_datatype_string(TYPES[self.type])

    def struct_field(self) -> T.StructField:
        held = {k: v for k, v in asdict(self.constraints).items() if v is not None}
        meta = {k: v for k, v in {"type": self.type, "constraints": held, "primaryKey": self.primaryKey, "references": self.references, "keyIndex": self.keyIndex, "group": self.group}.items() if v}
        return T.StructField(self.name, self.spark_type(), not (self.required or self.primaryKey), {"spec": json.dumps(meta)})


@dataclass
class Table:
    name: str
    fields: list[Field] = field(default_factory=list)
    id: str | None = None
    schema: str | None = None
    dbName: str | None = None
    isSubcollection: bool = False

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def keys(self) -> list[Field]:
        own = [f for f in self.fields if f.primaryKey]
        return sorted(own, key=lambda f: (f.keyIndex is None, f.keyIndex or 0))

    def struct_type(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    @classmethod
    def of(cls, name: str, schema: T.StructType) -> Table:
        """The fields of a DataFrame's schema, with the metadata that struct_type() leaves."""
        own = []
        for f in schema.fields:
            meta = json.loads(f.metadata.get("spec", "{}"))
            kind = meta.get("type") or spec_type(f.dataType)
            own.append(Field(f.name, kind, not f.nullable, constraints=Constraints(**meta.get("constraints", {})), primaryKey=bool(meta.get("primaryKey")), foreignKey=bool(meta.get("references")), references=meta.get("references"), keyIndex=meta.get("keyIndex"), group=meta.get("group")))
        return cls(name, own)


def spec_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    known = {T.LongType: "long", T.DecimalType: "decimal", T.BooleanType: "boolean", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.StructType: "object", T.MapType: "map", T.ArrayType: "array", T.BinaryType: "binary"}
    return next((v for k, v in known.items() if isinstance(kind, k)), "string")


@dataclass
class Relation:
    """type: one-to-one, one-to-many, many-to-one or many-to-many."""

    fromTable: str
    toTable: str
    type: str = "many-to-one"
    fromField: str | None = None
    toField: str | None = None
    fromFields: list[str] | None = None
    toFields: list[str] | None = None
    id: str | None = None
    required: bool = False
    minReferences: int | None = None
    maxReferences: int | None = None


@dataclass
class Schema:
    tables: list[Table] = field(default_factory=list)
    relations: list[Relation] = field(default_factory=list)
    version: str = "1"

    def table(self, name: str | None) -> Table | None:
        if not name:
            return None
        return next((t for t in self.tables if name in (t.name, t.id)), None) or next((t for t in self.tables if t.name.lower() == name.lower()), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        raw = json.loads(text)
        return cls([table_from(t) for t in raw["tables"]], [made(Relation, r) for r in raw.get("relations", [])], raw.get("version", "1"))


def made(cls, raw: dict):
    known = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in raw.items() if k in known})


def field_from(raw: dict) -> Field:
    out = made(Field, raw)
    out.type = canonical_type(out.type)
    out.constraints = raw["constraints"] if isinstance(raw.get("constraints"), Constraints) else made(Constraints, raw.get("constraints") or {})
    if raw.get("objectFields"):
        out.objectFields = [field_from(f) for f in raw["objectFields"]]
    return out


def table_from(raw: dict) -> Table:
    out = made(Table, raw)
    out.fields = [field_from(f) for f in raw.get("fields", [])]
    return out
