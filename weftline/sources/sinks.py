"""Where tables go and come from: a registry of writers by store, and readers with catalogue operations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Table
from .text import NESTED, insert_literal

Sink = Callable[[str, DataFrame], None]

# JDBC drivers and the quoting of their identifiers.
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver"}
# Formats of connectors that aren't part of Spark; they work where their package is on the class path.
CONNECTORS = {"mongodb": ("mongodb", "collection"), "firestore": ("firestore", "collection"), "dynamodb": ("dynamodb", "tableName"), "redis": ("org.apache.spark.sql.redis", "table")}
# Names that a production system may have.
PRODUCTION = [r"\bprod(uction)?\b", r"\blive\b", r"\bprd\b", r"[-_.]prod[-_.]"]


def is_production(target: str) -> bool:
    return any(re.search(p, target, re.I) for p in PRODUCTION)


def guarded(target: str, allow_production: bool) -> None:
    if is_production(target) and not allow_production:
        raise ValueError(f"{target} looks like a production system; pass allow_production=True to write there")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without them."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f"`{f.name}`") for f in df.schema.fields])


def mode(writer: DataFrameWriter, truncate: bool) -> DataFrameWriter:
    return writer.mode("overwrite" if truncate else "append")


def files(folder: str, kind: str = "parquet", truncate: bool = True, rows_a_file: int | None = None, **options) -> Sink:
    """A folder for each table: parquet, orc, json or csv (with a header, quotes doubled, null empty)."""

    def write(name: str, df: DataFrame) -> None:
        out = mode((flat(df) if kind == "csv" else df).write, truncate).options(**options)
        if kind == "csv":
            out = out.options(header=True, escape='"', nullValue="", emptyValue='""', timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if rows_a_file:
            out = out.option("maxRecordsPerFile", rows_a_file)
        out.format(kind).save(f"{folder}/{name}")

    return write


def inserts(folder: str, truncate: bool = True) -> Sink:
    """A folder of INSERT statements for each table."""
    return lambda name, df: mode(df.select(insert_literal(name, df).alias("value")).write, truncate).text(f"{folder}/{name}")


def memory(held: dict[str, DataFrame]) -> Sink:
    """Cached frames, and a temporary view for each."""

    def write(name: str, df: DataFrame) -> None:
        held[name] = df.cache()
        held[name].createOrReplaceTempView(name)

    return write


def nothing() -> Sink:
    return lambda name, df: df.write.format("noop").mode("overwrite").save()


def catalog(database: str, truncate: bool = True, bucket_by: tuple[int, str] | None = None) -> Sink:
    """Tables of Spark's catalogue; bucketed ones join on that column without a shuffle."""

    def write(name: str, df: DataFrame) -> None:
        out = mode(df.write, truncate)
        if bucket_by and bucket_by[1] in df.columns:
            out = out.bucketBy(*bucket_by).sortBy(bucket_by[1])
        out.saveAsTable(f"{database}.{name}")

    return write


def jdbc(url: str, truncate: bool = False, batch: int = 5000, allow_production: bool = False, **options) -> Sink:
    guarded(url, allow_production)
    driver = DRIVERS.get(url.split(":")[1])

    def write(name: str, df: DataFrame) -> None:
        out = mode(flat(df).write, truncate).format("jdbc").options(url=url, dbtable=name, batchsize=batch, truncate=truncate, **options)
        (out.option("driver", driver) if driver else out).save()

    return write


def execute(spark: SparkSession, url: str, statements: list[str], **options) -> list[int]:
    """Runs statements in the database, one after another in a transaction; rows that each changed."""
    driver = options.pop("driver", None) or DRIVERS.get(url.split(":")[1])
    if driver:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, str(v))
    connection, out = spark._jvm.java.sql.DriverManager.getConnection(url, properties), []
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for s in statements:
            out.append(statement.executeUpdate(s))
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
    return out


def new_rows(url: str, keys: dict[str, list[str]], batch: int = 5000, allow_production: bool = False, **options) -> Sink:
    """Into tables that exist: only rows whose key (keys[table]) isn't there yet, so a load may be repeated. Spark's tasks fill a staging table side by
    side, and the database takes from it what is new, in one statement of plain SQL."""
    guarded(url, allow_production)

    def write(name: str, df: DataFrame) -> None:
        stage = f"{name}_staged"
        jdbc(url, True, batch, True, **options)(stage, df.dropDuplicates(keys[name]))
        # staging columns are quoted as Spark made them
        mark = spark_quote(url)
        columns = ", ".join(mark(c) for c in df.columns)
        same = " AND ".join(f"{name}.{mark(k)} = s.{mark(k)}" for k in keys[name])
        take = f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {name} WHERE {same})"
        execute(df.sparkSession, url, [take, f"DROP TABLE {stage}"], **options)

    return write


def spark_quote(url: str) -> Callable[[str], str]:
    """Identifiers between the marks of the database."""
    left, right = {"mysql": "``", "sqlserver": "[]"}.get(url.split(":")[1], '""')
    return lambda name: f"{left}{name}{right}"


def foreign_key_statements(relations: list) -> list[str]:
    """ALTER TABLE statements that declare references once all tables are loaded."""
    out = []
    for r in relations:
        if r.type in ("many-to-many", "N:M"):
            continue
        child, mine, parent, theirs = (r.toTable, r.toFields or [r.toField], r.fromTable, r.fromFields or [r.fromField]) if r.type in ("one-to-many", "1:N") else (r.fromTable, r.fromFields or [r.fromField], r.toTable, r.toFields or [r.toField])
        if all(mine) and all(theirs):
            out.append(f"ALTER TABLE {child} ADD CONSTRAINT fk_{child}_{'_'.join(mine)} FOREIGN KEY ({', '.join(mine)}) REFERENCES {parent} ({', '.join(theirs)})")
    return out


def connector(store: str, allow_production: bool = False, **options) -> Sink:
    guarded(" ".join(map(str, options.values())), allow_production)
    kind, key = CONNECTORS[store]
    return lambda name, df: df.write.format(kind).mode("append").options(**{key: name}, **options).save()


SINKS: dict[str, Callable[..., Sink]] = {
    "parquet": lambda folder, **o: files(folder, "parquet", **o), "orc": lambda folder, **o: files(folder, "orc", **o), "json": lambda folder, **o: files(folder, "json", **o), "csv": lambda folder, **o: files(folder, "csv", **o),
    "sql": inserts, "memory": memory, "null": nothing, "catalog": catalog, **dict.fromkeys(DRIVERS, jdbc), **{s: (lambda s=s, **o: connector(s, **o)) for s in CONNECTORS},
}


def sink(store: str, *args, **options) -> Sink:
    if store not in SINKS:
        raise ValueError(f"unsupported store: {store}; known: {', '.join(SINKS)}")
    return SINKS[store](*args, **options)


# Reading and managing what is stored.
def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.format(kind).options(**options)
    if kind == "csv" and schema is None:
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


@dataclass
class Handler:
    """What is stored somewhere, whatever the store: its tables by name, as frames, with their schema and size."""

    spark: SparkSession
    names: Callable[[], list[str]]
    frame: Callable[[str], DataFrame]

    def tables(self) -> list[str]:
        return self.names()

    def read(self, name: str) -> DataFrame:
        return self.frame(name)

    def all(self) -> dict[str, DataFrame]:
        return {n: self.frame(n) for n in self.names()}

    def schema(self, name: str) -> Table:
        return Table.of(name.split(".")[-1], self.frame(name).schema)

    def has_data(self, name: str) -> bool:
        return not self.frame(name).isEmpty()

    def count(self, name: str) -> int:
        return self.frame(name).count()


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """The entries of a folder, by whatever file system it is on, without endings."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(n.rsplit(".", 1)[0] if "." in n else n for n in found if not n.startswith(("_", ".")))


def file_handler(spark: SparkSession, folder: str, kind: str, **options) -> Handler:
    def frame(name: str) -> DataFrame:
        return read(spark, f"{folder}/{name}{{,.{kind}}}", kind, **options)

    return Handler(spark, lambda: folder_names(spark, folder), frame)


def jdbc_handler(spark: SparkSession, url: str, names: list[str] | None = None, schema: str | None = None, key: dict[str, tuple[str, int, int, int]] | None = None, **options) -> Handler:
    """A database's tables. key: of large tables a number column, its least and greatest value and how many tasks read it side by side."""
    load = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more).load()

    def listed() -> list[str]:
        if names is not None:
            return names
        own = load(dbtable="information_schema.tables")
        own = own.toDF(*[c.lower() for c in own.columns]).where("table_type = 'BASE TABLE'")
        return [r["table_name"] for r in (own.where(F.col("table_schema") == schema) if schema else own).orderBy("table_name").collect()]

    def frame(name: str) -> DataFrame:
        split = (key or {}).get(name)
        more = dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), split, strict=True)) if split else {}
        return load(dbtable=f"{schema}.{name}" if schema else name, **more)

    return Handler(spark, listed, frame)


def catalog_handler(spark: SparkSession, database: str) -> Handler:
    return Handler(spark, lambda: tables(spark, database), lambda name: spark.table(f"{database}.{name}"))


def connector_handler(spark: SparkSession, store: str, names: list[str], **options) -> Handler:
    kind, key = CONNECTORS[store]
    return Handler(spark, lambda: names, lambda name: spark.read.format(kind).options(**{key: name}, **options).load())


def handler(spark: SparkSession, store: str, *args, **options) -> Handler:
    """Factory by store: parquet, orc, json, csv (a folder), catalog (a database), the JDBC stores (a url) and the document stores (names)."""
    if store in ("parquet", "orc", "json", "csv"):
        return file_handler(spark, *args, kind=store, **options)
    if store == "catalog":
        return catalog_handler(spark, *args)
    if store in DRIVERS:
        return jdbc_handler(spark, *args, **options)
    if store in CONNECTORS:
        return connector_handler(spark, store, *args, **options)
    raise ValueError(f"unsupported store: {store}")


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def create(spark: SparkSession, name: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def clear(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def stats(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """n_rows, n_files and n_bytes of a stored table."""
    df = read(spark, path, kind).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    return df.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("f").alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_bytes"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
