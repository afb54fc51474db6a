"""A schema as code of four object mappers, as a Spark StructType, and as a diagram."""

from __future__ import annotations

import json
import re

from ..functions.names import singular
from ..spec import Field, Schema, Table


def pascal(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z0-9]+", singular(name)) if p)


def camel(name: str) -> str:
    p = pascal(name)
    return p[:1].lower() + p[1:]


def target(schema: Schema, f: Field) -> Table | None:
    return schema.table((f.references or "").split(".")[0] or None)


# Types of the targets; what isn't listed is text.
PRISMA = {"integer": "Int", "long": "BigInt", "number": "Float", "float": "Float", "decimal": "Decimal", "boolean": "Boolean", "date": "DateTime", "timestamp": "DateTime", "timestamptz": "DateTime", "object": "Json", "json": "Json", "map": "Json", "geopoint": "Json", "binary": "Bytes", "bytes": "Bytes"}
TYPEORM = {"integer": ("int", "number"), "long": ("bigint", "string"), "number": ("double precision", "number"), "float": ("double precision", "number"), "decimal": ("decimal", "string"), "boolean": ("boolean", "boolean"), "date": ("date", "Date"), "timestamp": ("timestamp", "Date"), "timestamptz": ("timestamptz", "Date"), "object": ("jsonb", "object"), "json": ("jsonb", "object"), "map": ("jsonb", "object"), "geopoint": ("jsonb", "object"), "uuid": ("uuid", "string"), "binary": ("bytea", "Buffer"), "bytes": ("bytea", "Buffer")}
DRIZZLE = {"integer": "integer", "long": "bigint", "number": "doublePrecision", "float": "doublePrecision", "decimal": "numeric", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "object": "jsonb", "json": "jsonb", "map": "jsonb", "geopoint": "jsonb", "uuid": "uuid"}
MONGOOSE = {"integer": "Number", "long": "Number", "number": "Number", "float": "Number", "decimal": "Schema.Types.Decimal128", "boolean": "Boolean", "date": "Date", "timestamp": "Date", "timestamptz": "Date", "object": "Schema.Types.Mixed", "json": "Schema.Types.Mixed", "map": "Map", "objectid": "Schema.Types.ObjectId", "binary": "Buffer", "bytes": "Buffer"}
DIAGRAM = {"integer": "int", "long": "bigint", "number": "float", "float": "float", "decimal": "decimal", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "object": "json", "json": "json", "map": "json", "uuid": "uuid", "objectid": "objectid"}
ARROWS = {"one-to-one": "||--||", "one-to-many": "||--o{", "many-to-one": "}o--||", "many-to-many": "}o--o{"}


def prisma(schema: Schema) -> str:
    back: dict[str, list[str]] = {}
    models = []
    for t in schema.tables:
        rows, keys = [], t.keys()
        for f in t.fields:
            kind = PRISMA.get(f.type, "String") + ("[]" if f.type in ("array", "set") else "")
            marks = [" @id"] if f.primaryKey and len(keys) == 1 else []
            marks += [" @default(autoincrement())"] if f.isSerial else []
            marks += [" @unique"] if f.constraints.unique and not f.primaryKey else []
            rows.append(f"  {f.name} {kind}{'' if f.required or f.primaryKey or kind.endswith('[]') else '?'}{''.join(marks)}")
            p = target(schema, f)
            if p:
                name = re.sub(r"_?id$", "", f.name, flags=re.I) or camel(p.name)
                name = f"{name}_ref" if name == f.name or t.field(name) else name
                link = f"{t.name}_{f.name}"
                column = (f.references.split(".") + ["id"])[1] if "." in f.references else (p.keys()[0].name if p.keys() else "id")
                rows.append(f'  {name} {pascal(p.name)}{"" if f.required else "?"} @relation("{link}", fields: [{f.name}], references: [{column}])')
                back.setdefault(p.name, []).append(f'  {camel(t.name)}_{f.name}_list {pascal(t.name)}[] @relation("{link}")')
        if len(keys) > 1:
            rows.append(f"  @@id([{', '.join(k.name for k in keys)}])")
        models.append((t, rows))
    out = ['generator client {\n  provider = "prisma-client-js"\n}', 'datasource db {\n  provider = "postgresql"\n  url      = env("DATABASE_URL")\n}']
    for t, rows in models:
        out.append(f"model {pascal(t.name)} {{\n" + "\n".join([*rows, *back.get(t.name, []), f'  @@map("{t.name}")']) + "\n}")
    return "\n\n".join(out) + "\n"


def typeorm(schema: Schema) -> str:
    out = ['import { Column, Entity, JoinColumn, ManyToOne, PrimaryColumn, PrimaryGeneratedColumn } from "typeorm";']
    for t in schema.tables:
        rows = []
        for f in t.fields:
            sql, ts = TYPEORM.get(f.type, ("text", "string"))
            options = {"type": sql} | ({} if f.required or f.primaryKey else {"nullable": True}) | ({"unique": True} if f.constraints.unique else {}) | ({"array": True} if f.type in ("array", "set") else {})
            mark = "@PrimaryGeneratedColumn()" if f.isSerial and f.primaryKey else f"@PrimaryColumn({json.dumps(options)})" if f.primaryKey else f"@Column({json.dumps(options)})"
            rows.append(f"  {mark}\n  {f.name}{'!' if f.required or f.primaryKey else '?'}: {ts}{'[]' if f.type in ('array', 'set') else ''};")
            p = target(schema, f)
            if p:
                rows.append(f'  @ManyToOne(() => {pascal(p.name)})\n  @JoinColumn({{ name: "{f.name}" }})\n  {f.name}Ref?: {pascal(p.name)};')
        out.append(f'@Entity("{t.name}")\nexport class {pascal(t.name)} {{\n' + "\n\n".join(rows) + "\n}")
    return "\n\n".join(out) + "\n"


def drizzle(schema: Schema) -> str:
    used: set[str] = {"pgTable"}
    tables = []
    for t in schema.tables:
        rows, keys = [], t.keys()
        for f in t.fields:
            kind = "bigserial" if f.isSerial and f.type == "long" else "serial" if f.isSerial else DRIZZLE.get(f.type, "text")
            used.add(kind)
            extra = ', { mode: "number" }' if kind.startswith("big") else ", { withTimezone: true }" if f.type == "timestamptz" else ""
            marks = ".array()" if f.type in ("array", "set") else ""
            marks += ".primaryKey()" if f.primaryKey and len(keys) == 1 else ".notNull()" if f.required or f.primaryKey else ""
            marks += ".unique()" if f.constraints.unique and not f.primaryKey else ""
            p = target(schema, f)
            if p:
                marks += f".references(() => {camel(p.name)}Table.{p.keys()[0].name if p.keys() else 'id'})"
            rows.append(f'  {f.name}: {kind}("{f.name}"{extra}){marks},')
        tail = ""
        if len(keys) > 1:
            used.add("primaryKey")
            tail = ", (t) => [primaryKey({ columns: [" + ", ".join(f"t.{k.name}" for k in keys) + "] })]"
        tables.append(f'export const {camel(t.name)}Table = pgTable("{t.name}", {{\n' + "\n".join(rows) + f"\n}}{tail});")
    return f'import {{ {", ".join(sorted(used))} }} from "drizzle-orm/pg-core";\n\n' + "\n\n".join(tables) + "\n"


def mongoose(schema: Schema) -> str:
    out = ['import { Schema, model } from "mongoose";']
    for t in schema.tables:
        rows = []
        for f in t.fields:
            if f.name == "_id":
                continue
            p = target(schema, f)
            kind = MONGOOSE.get(f.type, "String")
            parts = [f"type: {'[' + MONGOOSE.get(f.arrayItemType or '', 'String') + ']' if f.type in ('array', 'set') else kind}"]
            parts += ["required: true"] if f.required or f.primaryKey else []
            parts += ["unique: true"] if f.primaryKey or f.constraints.unique else []
            parts += [f'ref: "{pascal(p.name)}"'] if p else []
            c = f.constraints
            parts += [f"{k}: {json.dumps(v)}" for k, v in (("enum", c.enum), ("min", c.min), ("max", c.max), ("minlength", c.minLength), ("maxlength", c.maxLength), ("trim", c.trim), ("lowercase", c.lowercase)) if v is not None]
            rows.append(f"  {f.name}: {{ {', '.join(parts)} }},")
        name = pascal(t.name)
        out.append(f"const {camel(t.name)}Schema = new Schema({{\n" + "\n".join(rows) + f'\n}}, {{ collection: "{t.name}" }});\n\nexport const {name} = model("{name}", {camel(t.name)}Schema);')
    return "\n\n".join(out) + "\n"


def struct_types(schema: Schema) -> str:
    """Python code that builds each table's StructType."""
    out = ["from pyspark.sql import types as T"]
    for t in schema.tables:
        rows = [f"    T.StructField({f.name!r}, T.{x.dataType!r}, {x.nullable})," for f, x in zip(t.fields, t.struct_type().fields, strict=True)]
        rows = [re.sub(r"(?<![.\w])(StructType|StructField|ArrayType|MapType|\w+Type)\(", r"T.\1(", r.replace("T.StructField", "StructField").replace("T.", "")) for r in rows]
        rows = [r.replace("    StructField(", "    T.StructField(") for r in rows]
        out.append(f"{t.name} = T.StructType([\n" + "\n".join(rows) + "\n])")
    return "\n\n".join(out) + "\n"


# The file that each target's code goes to.
TARGETS = {"prisma": (prisma, "schema.prisma"), "typeorm": (typeorm, "entities.ts"), "drizzle": (drizzle, "schema.ts"), "mongoose": (mongoose, "models.ts"), "spark": (struct_types, "schemas.py")}


def generate(schema: Schema, kind: str) -> tuple[str, str]:
    """File name and code."""
    if kind not in TARGETS:
        raise ValueError(f"unknown target: {kind}; known: {', '.join(TARGETS)}")
    make, name = TARGETS[kind]
    return name, make(schema)


def diagram(schema: Schema, title: str | None = None) -> str:
    """An entity diagram in Mermaid's notation; without relations the foreign keys are drawn."""
    box = lambda n: re.sub(r"[^A-Z0-9_]", "_", n.upper())
    lines = ["erDiagram"]
    for t in schema.tables:
        lines.append(f"  {box(t.name)} {{")
        for f in t.fields:
            own = f.constraints.enum
            note = f' "{"|".join(map(str, own[:3]))}{"…" if len(own) > 3 else ""}"' if own else ""
            lines.append(f"    {DIAGRAM.get(f.type, 'string')} {f.name}{' PK' if f.primaryKey else ' FK' if f.foreignKey or f.references else ''}{note}")
        lines.append("  }")
    drawn = [(r.fromTable, ARROWS.get(r.type, "}o--||"), r.toTable, r.fromField or "references") for r in schema.relations]
    if not drawn:
        drawn = [(t.name, "}o--||", p.name, f.name) for t in schema.tables for f in t.fields if (p := target(schema, f))]
    seen = set()
    for a, arrow, b, label in drawn:
        if (a, b) not in seen:
            seen.add((a, b))
            lines.append(f'  {box(a)} {arrow} {box(b)} : "{label}"')
    n = len(schema.tables)
    head = f"## {title}\n\n" if title else ""
    return f"{head}```mermaid\n" + "\n".join(lines) + f"\n```\n\n*{n} table{'' if n == 1 else 's'}, {sum(len(t.fields) for t in schema.tables)} fields*"
