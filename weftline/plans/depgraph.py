"""Order of tables and of columns by what they depend on. Metadata, so plain Python; levels() of edges also as recursive SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import singular
from ..spec import Relation, Schema, Table


@dataclass
class Graph:
    """needs[t]: tables that must come before t; strong[t]: those of them that t can't do without."""

    names: list[str]
    needs: dict[str, set[str]] = field(default_factory=dict)
    strong: dict[str, set[str]] = field(default_factory=dict)

    def add(self, child: str, parent: str, strong: bool) -> None:
        if child != parent and child in self.needs and parent in self.needs:
            self.needs[child].add(parent)
            if strong:
                self.strong[child].add(parent)


def table_graph(schema: Schema) -> Graph:
    """1:1 and N:1 make the first table need the second, 1:N the reverse, N:M both weakly; so do reference fields and ...Id names."""
    names = [t.name for t in schema.tables]
    out = Graph(names, {n: set() for n in names}, {n: set() for n in names})

    def must(table: Table | None, name: str | None) -> bool:
        own = table and name and table.field(name)
        return not own or own.required

    for r in schema.relations:
        a, b = schema.table(r.fromTable), schema.table(r.toTable)
        if not a or not b:
            continue
        if r.type in ("one-to-one", "many-to-one", "1:1", "N:1"):
            out.add(a.name, b.name, must(a, r.fromField))
        elif r.type in ("one-to-many", "1:N"):
            out.add(b.name, a.name, must(b, r.toField))
        else:
            out.add(a.name, b.name, False)
            out.add(b.name, a.name, False)
    for t in schema.tables:
        for f in t.fields:
            target = schema.table((f.references or "").split(".")[0] or None)
            if not target and f.type == "objectid" and f.name.endswith("Id"):
                base = f.name[:-2].lower()
                target = next((x for x in schema.tables if base in (x.name.lower(), singular(x.name.lower()))), None)
            if target:
                out.add(t.name, target.name, f.required)
    return out


def levels(graph: Graph) -> tuple[list[list[str]], bool]:
    """Tables by level, and whether a cycle had to be broken: at the first table left without an open strong need, else the first left."""
    left, done, out, cyclic = list(graph.names), set(), [], False
    while left:
        free = [n for n in left if graph.needs[n] <= done]
        if not free:
            cyclic = True
            free = [next((n for n in left if graph.strong[n] <= done), left[0])]
        out.append(free)
        done |= set(free)
        left = [n for n in left if n not in done]
    return out, cyclic


def table_order(schema: Schema) -> list[str]:
    return [n for level in levels(table_graph(schema))[0] for n in level]


def catalog_order(schema: Schema) -> tuple[list[str], set[str]]:
    """Tables by their declared references only, and those that refer to themselves: what a relational store that checks keys needs.

    A reference that may be null is weak and gives way in a cycle; a reference to the table itself is no dependency.
    """
    names = [t.name for t in schema.tables]
    out, own = Graph(names, {n: set() for n in names}, {n: set() for n in names}), set()
    told = set()
    for r in schema.relations:
        if r.type in ("many-to-many", "N:M"):
            continue
        child, parent = (schema.table(x) for x in ((r.toTable, r.fromTable) if r.type in ("one-to-many", "1:N") else (r.fromTable, r.toTable)))
        if child and parent:
            columns = r.fromFields or [r.toField if r.type in ("one-to-many", "1:N") else r.fromField]
            told |= {(child.name, c) for c in columns}
            fields = [f for f in map(child.field, filter(None, columns)) if f]
            out.add(child.name, parent.name, all(f.required for f in fields))
            own |= {child.name} if child is parent else set()
    for t in schema.tables:
        for f in t.fields:
            parent = schema.table((f.references or "").rsplit(".", 1)[0] or None) or schema.table((f.references or "").split(".")[0] or None)
            if parent and (t.name, f.name) not in told:
                out.add(t.name, parent.name, f.required)
                own |= {t.name} if parent is t else set()
    return [n for level in levels(out)[0] for n in level], own


def given_order(schema: Schema) -> list[str]:
    """Tables as they are listed: for stores that check no references."""
    return [t.name for t in schema.tables]


#: How the tables are ordered for a store.
ORDERS = {"postgresql": lambda s: catalog_order(s)[0], "mysql": lambda s: catalog_order(s)[0], "sqlserver": lambda s: catalog_order(s)[0], "sqlite": table_order, "memory": given_order, "null": given_order, "parquet": given_order, "json": given_order, "csv": given_order}


def order_for(store: str, schema: Schema) -> list[str]:
    return ORDERS.get(store, table_order)(schema)


def column_order(table: Table) -> list[str]:
    """Fields so that each comes after the columns its constraints look at; of a cycle one edge is dropped, the last that closes it, and all others hold."""
    names = [f.name for f in table.fields]
    needs: dict[str, list[str]] = {n: [] for n in names}

    def reaches(a: str, b: str) -> bool:
        seen, left = set(), [a]
        while left:
            x = left.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                left += needs[x]
        return False

    wanted = [(f.name, x) for f in table.fields for x in (f.constraints.minColumn, f.constraints.maxColumn, f.constraints.gtColumn, f.constraints.ltColumn)]
    wanted += [("updatedAt", "createdAt")]
    for a, b in wanted:
        if a in needs and b in needs and a != b and b not in needs[a] and not reaches(b, a):
            needs[a].append(b)
    out: list[str] = []
    while len(out) < len(names):
        out.append(next(n for n in names if n not in out and set(needs[n]) <= set(out)))
    return out


def recursive_levels(spark: SparkSession, edges: list[tuple[str, str]]) -> DataFrame:
    """table and level (0: needs nothing) for acyclic edges (child, parent), by a recursive query."""
    held = spark.createDataFrame(edges, "child string, parent string")
    return spark.sql(
        """
        WITH RECURSIVE walk(name, level) AS (
            SELECT DISTINCT parent, 0 FROM {edges} WHERE parent NOT IN (SELECT child FROM {edges})
            UNION ALL
            SELECT e.child, walk.level + 1 FROM walk JOIN {edges} e ON e.parent = walk.name)
        SELECT name, max(level) AS level FROM walk GROUP BY name""",
        edges=held,
    )


def relation_edges(relations: list[Relation]) -> list[tuple[str, str]]:
    return [(r.toTable, r.fromTable) if r.type in ("one-to-many", "1:N") else (r.fromTable, r.toTable) for r in relations if r.type not in ("many-to-many", "N:M")]
