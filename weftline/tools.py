"""Six tools over JSON-like arguments: generate, design, validate, diff, seed, visualize."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from .operators.generate import Config, Generator
from .plans import codegen, schema_diff
from .plans import design as plans
from .sources import sinks
from .sources.text import csv_line, insert_literal


def generate_data(spark: SparkSession, schema: Any, counts: dict[str, int] | int = 10, seed: Any = 42, output: str = "json", path: str | None = None, preview: int = 5, **options) -> dict:
    """Text of the generated rows (json, csv or sql), bounded by `preview` rows a table; all rows go to `path` if one is given."""
    spec = plans.parse(schema)
    counts = {t.name: counts for t in spec.tables} if isinstance(counts, int) else counts
    generator = Generator(spec, Config(counts, seed, **options))
    out: dict = {"tables": {}, "warnings": generator.warnings, "path": path}
    for name, df in generator.tables(spark).items():
        if path:
            sinks.sink({"sql": "sql"}.get(output, output), path)(name, df)
        if output == "json":
            text = [json.loads(r) for r in df.limit(preview).toJSON().collect()]
        elif output == "csv":
            text = [",".join(df.columns), *(r[0] for r in df.limit(preview).select(csv_line(df)).collect())]
        else:
            text = [r[0] for r in df.limit(preview).select(insert_literal(name, df)).collect()]
        out["tables"][name] = {"rows": counts[name], "preview": text}
    return out


def design_schema(entities: list[dict], relationships: list[dict] = (), store: str = "postgresql") -> dict:
    return json.loads(plans.design(entities, relationships, store).to_json())


def validate_schema(schema: Any, strict: bool = False) -> dict:
    issues = plans.lint(schema, strict)
    counts = plans.severities(issues)
    return {"valid": not counts["error"], "counts": counts, "issues": issues}


def diff_schemas(old: Any, new: Any, mode: str = "full", output: str = "summary", dialect: str = "postgresql") -> dict | list[str]:
    d = schema_diff.diff(schema_diff.snapshot(plans.parse(old)), plans.parse(new), mode)
    if output == "ddl":
        return [s.sql for s in schema_diff.ddl(d, dialect)]
    if output == "summary":
        return d.summary()
    return {
        "addedTables": {n: [c.name for c in cols] for n, cols in d.added.items()}, "removedTables": list(d.removed),
        "modifiedTables": {m.table: {"added": [c.name for c in m.added], "removed": [c.name for c in m.removed], "changed": {c.new.name: [c.old.type, c.new.type] for c in m.changed}} for m in d.modified},
        **d.summary(),
    }


def seed_database(spark: SparkSession, schema: Any, counts: dict[str, int] | int, store: str, *args, seed: Any = 42, truncate_first: bool = False, allow_production: bool = False, **options) -> dict:
    """Generates into a store. truncate_first replaces what is there."""
    for x in (*args, *options.values()):
        if isinstance(x, str):
            sinks.guarded(x, allow_production)
    spec = plans.parse(schema)
    counts = {t.name: counts for t in spec.tables} if isinstance(counts, int) else counts
    if store in ("parquet", "orc", "json", "csv", "sql", "catalog", *sinks.DRIVERS):
        options["truncate"] = truncate_first
    generator = Generator(spec, Config(counts, seed))
    results = generator.write(spark, sinks.sink(store, *args, **options))
    return {"results": results, "rows": sum(r["rows"] for r in results), "errors": [plans.friendly(r["error"]) for r in results if r["error"]], "warnings": generator.warnings}


def visualize_schema(schema: Any, title: str | None = None) -> str:
    return codegen.diagram(plans.parse(schema), title)
