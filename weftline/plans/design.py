"""Schemas from loose input: lists, maps and JSON text; designs from entities; lint of either."""

from __future__ import annotations

import json
import re
from collections import Counter
from typing import Any

from ..spec import ALIASES, TYPES, Constraints, Field, Relation, Schema, Table, canonical_type, field_from

DEEPEST = 5
TIME_NAMES = ("createdat", "updatedat", "created_at", "updated_at", "timestamp")


def value_field(name: str, value: Any, depth: int = 0) -> Field:
    """A field from a sample value, a type's name, or a description with a type."""
    info = value if isinstance(value, dict) and "type" in value else {}
    sample = info.get("type", value)
    f = Field(name)
    if info:
        f.required = bool(info.get("required", info.get("nullable") is False))
        f.primaryKey = bool(info.get("isPrimaryKey", info.get("primaryKey", False)))
        f.foreignKey = bool(info.get("isForeignKey", info.get("foreignKey", False)))
        f.references = info.get("references") or info.get("referencedCollectionId")
        f.rawType, f.isSerial, f.default = info.get("rawType"), bool(info.get("isSerial", False)), info.get("default", info.get("defaultValue"))
        known = {k: v for k, v in (info.get("constraints") or {}).items() if k in Constraints.__dataclass_fields__}
        f.constraints = Constraints(**known)
        if info.get("isUnique") or info.get("unique"):
            f.constraints.unique = True
        f.arrayItemType = info.get("arrayItemType")
        if info.get("objectFields") and depth < DEEPEST:
            f.objectFields = fields_of(info["objectFields"], depth + 1)
    if name == "_id":
        f.type, f.constraints.unique = "objectid", True
    elif sample is None:
        f.type = "null"
    elif isinstance(sample, bool):
        f.type = "boolean"
    elif isinstance(sample, int):
        f.type = "integer"
    elif isinstance(sample, float):
        f.type = "integer" if sample.is_integer() else "number"
    elif isinstance(sample, str):
        low = sample.lower()
        known = low in TYPES or low in ALIASES or low.split("(")[0] in ALIASES
        f.type = canonical_type(low) if known else "timestamp" if re.match(r"\d{4}-\d{2}-\d{2}T", sample) or name.lower() in TIME_NAMES else "string"
    elif isinstance(sample, list):
        f.type = "array"
        if sample:
            f.arrayItemType = value_field("item", sample[0], depth + 1).type
    elif isinstance(sample, dict):
        keys = {k.lower() for k in sample}
        if keys in ({"lat", "lng"}, {"latitude", "longitude"}, {"_latitude", "_longitude"}):
            f.type = "geopoint"
        else:
            f.type = "object"
            f.objectFields = fields_of(sample, depth + 1) or None if depth < DEEPEST else None
    return f


def fields_of(raw: Any, depth: int = 0) -> list[Field]:
    """Fields from a list of fields, a map of names to values or types, or the JSON text of either. _id first, then by name."""
    if depth > DEEPEST:
        return []
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError:
            return []
    if isinstance(raw, list):
        return [value_field(x["name"], x, depth) if isinstance(x, dict) and "name" in x else Field(x if isinstance(x, str) else f"Field {k + 1}") for k, x in enumerate(raw)]
    out = []
    for name, value in raw.items():
        if name.startswith("_subcollections"):
            continue
        if name.isdigit():  # a numbered list written as a map
            if isinstance(value, dict) and isinstance(value.get("name"), str):
                name = value["name"]
            elif isinstance(value, str) and value.lower() not in TYPES:
                name, value = value, "string"
        out.append(value_field(name, value, depth))
    return sorted(out, key=lambda f: (f.name != "_id", f.name))


def parse(raw: Any) -> Schema:
    """A schema from a list of tables, a map of table names to fields, an object with tables (or collections), or JSON text."""
    if isinstance(raw, Schema):
        return raw
    if isinstance(raw, str):
        try:
            raw = json.loads(raw)
        except ValueError as e:
            raise ValueError(f"SCHEMA_PARSE_ERROR: {e}") from e
    relations: list[Relation] = []
    if isinstance(raw, dict) and ("tables" in raw or "collections" in raw):
        for r in raw.get("relations", raw.get("relationships", [])):
            relations.append(Relation(r.get("fromTable") or r.get("fromCollectionId"), r.get("toTable") or r.get("toCollectionId"), r.get("type", "many-to-one"), r.get("fromField"), r.get("toField"), r.get("fromFields"), r.get("toFields"), r.get("id")))
        raw = raw.get("tables", raw.get("collections"))
    if isinstance(raw, dict):
        return Schema([Table(n, fields_of(f.get("fields", f) if isinstance(f, dict) else f)) for n, f in raw.items()], relations)
    if isinstance(raw, list):
        return Schema([Table(t.get("name", ""), fields_of(t.get("fields", [])), t.get("id"), t.get("schema")) for t in raw], relations)
    raise ValueError("SCHEMA_PARSE_ERROR: neither a list nor an object")


def named(entity: str) -> str:
    return re.sub(r"\s+", "_", entity.strip().lower())


def design(entities: list[dict], relationships: list[dict] = (), store: str = "postgresql") -> Schema:
    """Tables from entities, with id, created_at and updated_at unless they say otherwise, and the foreign keys of relationships."""
    key_type = {"mongodb": "objectid", "firestore": "string", "dynamodb": "string", "mysql": "integer", "sqlite": "integer", "sqlserver": "integer"}.get(store, "uuid")
    out = Schema()
    for e in entities:
        t = Table(named(e["name"]), id=named(e["name"]))
        for f in e.get("fields", []):
            limits = {"unique": f.get("unique"), "enum": f.get("enum"), "maxLength": f.get("max_length"), "min": f.get("min"), "max": f.get("max")}
            t.fields.append(field_from({"name": f["name"], "type": f.get("type", "string"), "required": f.get("required", False), "default": f.get("default_value"), "primaryKey": f.get("is_primary_key", False), "foreignKey": bool(f.get("is_foreign_key") or f.get("references")), "references": f.get("references"), "description": f.get("description"), "constraints": {k: v for k, v in limits.items() if v is not None}}))
        if e.get("add_standard_fields", True):
            if not t.keys() and not t.field("id"):
                t.fields.insert(0, Field("id", key_type, True, primaryKey=True))
            for name in ("created_at", "updated_at"):
                if not t.field(name):
                    t.fields.append(Field(name, "timestamp", True, "CURRENT_TIMESTAMP"))
        out.tables.append(t)
    for r in relationships:
        a, b = out.table(named(r["from_collection"])), out.table(named(r["to_collection"]))
        if not a or not b:
            continue
        name = r.get("from_field") or f"{b.name}_id"
        if r["type"] != "many-to-many" and not any(f.name == name or f.references == b.name for f in a.fields):
            a.fields.append(Field(name, b.keys()[0].type if b.keys() else key_type, r["type"] == "many-to-one", foreignKey=True, references=b.name))
        out.relations.append(Relation(a.name, b.name, r["type"], name, id=f"{a.name}-{b.name}-{name}"))
    return out


def issue(severity: str, code: str, message: str, table: str | None = None, field: str | None = None) -> dict:
    return {"severity": severity, "code": code, "table": table, "field": field, "message": message}


def lint(raw: Any, strict: bool = False) -> list[dict]:
    """What is wrong or doubtful in a schema. strict adds matters of style."""
    try:
        schema = parse(raw)
    except ValueError as e:
        return [issue("error", "SCHEMA_PARSE_ERROR", str(e))]
    out: list[dict] = []
    known = {t.name for t in schema.tables} | {t.id for t in schema.tables}
    for t in schema.tables:
        if not t.fields:
            out.append(issue("error", "NO_FIELDS", f"{t.name} has no fields", t.name))
            continue
        if not t.name.strip():
            out.append(issue("error", "MISSING_COLLECTION_NAME", "a table has no name"))
        if re.search(r"\s", t.name):
            out.append(issue("warning", "COLLECTION_NAME_HAS_SPACES", f"{t.name!r} has blanks in its name", t.name))
        for name, n in Counter(f.name for f in t.fields).items():
            out += [issue("error", "DUPLICATE_FIELD_NAME", f"{t.name} has {name} twice", t.name, name)] * (n - 1)
        for f in t.fields:
            out += lint_field(t, f, known, strict)
        keys = len(t.keys())
        if not keys:
            out.append(issue("error", "NO_PRIMARY_KEY", f"{t.name} has no primary key", t.name))
        if keys > 2:
            out.append(issue("warning", "MANY_PRIMARY_KEYS", f"{t.name} has {keys} primary key fields", t.name))
        if strict:
            names = {f.name.lower().replace("_", "") for f in t.fields}
            out += [issue("info", code, f"{t.name} has no {name}", t.name) for name, code in (("createdat", "MISSING_CREATED_AT"), ("updatedat", "MISSING_UPDATED_AT")) if name not in names]
    for name, n in Counter(r.id for r in schema.relations if r.id).items():
        out += [issue("error", "DUPLICATE_RELATIONSHIP_ID", f"relation {name} is there twice")] * (n - 1)
    for r in schema.relations:
        if r.fromTable not in known:
            out.append(issue("error", "RELATIONSHIP_UNKNOWN_FROM", f"a relation comes from {r.fromTable}, which isn't there"))
        if r.toTable not in known:
            out.append(issue("error", "RELATIONSHIP_UNKNOWN_TO", f"a relation goes to {r.toTable}, which isn't there"))
        if r.fromTable == r.toTable:
            out.append(issue("info", "SELF_REFERENTIAL_RELATIONSHIP", f"{r.fromTable} refers to itself", r.fromTable))
    return out


def lint_field(t: Table, f: Field, known: set, strict: bool) -> list[dict]:
    if not f.name.strip():
        return [issue("error", "MISSING_FIELD_NAME", f"a field of {t.name} has no name", t.name)]
    checks = [
        (f.type not in TYPES, "error", "INVALID_FIELD_TYPE", f"{f.name} has the unknown type {f.type}"),
        (bool(f.references) and f.references.split(".")[0] not in known, "error", "UNRESOLVED_FK_REFERENCE", f"{f.name} refers to {f.references}, which isn't there"),
        (bool(f.constraints.enum) and f.type not in ("string", "symbol"), "warning", "ENUM_ON_NON_STRING", f"{f.name} has an enum but is {f.type}"),
        (f.type == "string" and f.constraints.min is not None, "info", "MIN_ON_STRING", f"{f.name} is text: use minLength"),
        (f.type == "array" and not f.arrayItemType, "warning", "ARRAY_MISSING_ITEM_TYPE", f"{f.name} doesn't say what it holds"),
        (f.type == "object" and not f.objectFields, "warning", "OBJECT_MISSING_FIELDS", f"{f.name} doesn't say what it holds"),
        (strict and bool(re.search(r"\s", f.name)), "warning", "FIELD_NAME_HAS_SPACES", f"{f.name!r} has blanks in its name"),
        (strict and f.required and f.default == "null", "warning", "REQUIRED_FIELD_NULL_DEFAULT", f"{f.name} is required but null by default"),
    ]
    return [issue(s, c, m, t.name, f.name) for broken, s, c, m in checks if broken]


def severities(issues: list[dict]) -> dict[str, int]:
    return {s: sum(i["severity"] == s for i in issues) for s in ("error", "warning", "info")}


# Parts of error texts and what they mean for the reader.
ERRORS = [
    (r"ECONNREFUSED|connection refused", "The server can't be reached. Is it running, and is the port right?"),
    (r"timed? ?out", "The server took too long to answer."),
    (r"password|authentication|access denied|28P01", "The user name or password is wrong."),
    (r"database .* does not exist|unknown database|3D000", "There is no such database."),
    (r"TABLE_OR_VIEW_NOT_FOUND|no such table|relation .* does not exist", "There is no such table."),
    (r"PATH_NOT_FOUND|No such file", "There is nothing at this path."),
    (r"duplicate key|unique constraint|23505", "A row with this key is there already."),
    (r"foreign key|23503", "A row refers to one that isn't there."),
    (r"ClassNotFoundException|No suitable driver", "The connector's package isn't on the class path."),
    (r"permission denied|42501", "The user may not do this."),
]


def friendly(error: BaseException | str) -> str:
    text = str(error)
    return next((said for pattern, said in ERRORS if re.search(pattern, text, re.I)), text.splitlines()[0] if text else "Something went wrong.")
