"""What a declared catalogue says, as queries over views in the shape of information_schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans import catalog as K
from .registry import query

# A star schema's declaration: columns, keys, references (one composite) and checks.
COLUMNS = [
    ("region", "r_regionkey", 1, "integer", "NO", None, None), ("region", "r_name", 2, "character varying", "NO", None, 25),
    ("nation", "n_nationkey", 1, "integer", "NO", None, None), ("nation", "n_name", 2, "character varying", "NO", "'unknown'::character varying", 25), ("nation", "n_regionkey", 3, "integer", "NO", None, None),
    ("orders", "o_orderkey", 1, "bigint", "NO", "nextval('orders_seq')", None), ("orders", "o_status", 2, "text", "YES", None, None), ("orders", "o_total", 3, "numeric", "YES", None, None),
    ("lineitem", "l_orderkey", 1, "bigint", "NO", None, None), ("lineitem", "l_linenumber", 2, "integer", "NO", None, None), ("lineitem", "l_quantity", 3, "integer", "NO", "1", None),
    ("refunds", "id", 1, "integer", "NO", None, None), ("refunds", "line", 2, "integer", "NO", None, None), ("refunds", "order_key", 3, "bigint", "NO", None, None), ("refunds", "nation", 4, "integer", "YES", None, None),
]
CONSTRAINTS = [
    ("region_pkey", "region", "PRIMARY KEY"), ("nation_pkey", "nation", "PRIMARY KEY"), ("nation_name", "nation", "UNIQUE"), ("nation_region", "nation", "FOREIGN KEY"), ("orders_pkey", "orders", "PRIMARY KEY"), ("orders_status", "orders", "CHECK"), ("orders_total", "orders", "CHECK"),
    ("lineitem_pkey", "lineitem", "PRIMARY KEY"), ("lineitem_order", "lineitem", "FOREIGN KEY"), ("lineitem_quantity", "lineitem", "CHECK"), ("refunds_pkey", "refunds", "PRIMARY KEY"), ("refunds_line", "refunds", "FOREIGN KEY"), ("refunds_once", "refunds", "UNIQUE"), ("refunds_nation", "refunds", "FOREIGN KEY"),
]
USAGE = [
    ("region_pkey", "region", "r_regionkey", 1, None), ("nation_pkey", "nation", "n_nationkey", 1, None), ("nation_name", "nation", "n_name", 1, None), ("nation_region", "nation", "n_regionkey", 1, 1), ("orders_pkey", "orders", "o_orderkey", 1, None),
    ("lineitem_pkey", "lineitem", "l_orderkey", 1, None), ("lineitem_pkey", "lineitem", "l_linenumber", 2, None), ("lineitem_order", "lineitem", "l_orderkey", 1, 1), ("refunds_pkey", "refunds", "id", 1, None),
    ("refunds_line", "refunds", "line", 1, 2), ("refunds_line", "refunds", "order_key", 2, 1), ("refunds_once", "refunds", "order_key", 1, None), ("refunds_once", "refunds", "line", 2, None), ("refunds_nation", "refunds", "nation", 1, 1),
]
REFERENCES = [("nation_region", "region_pkey"), ("lineitem_order", "orders_pkey"), ("refunds_line", "lineitem_pkey"), ("refunds_nation", "nation_pkey")]
CHECKS = [("orders_status", "((o_status)::text = ANY (ARRAY['O'::text, 'F'::text]))"), ("orders_total", "((o_total >= 0) AND (o_total < 1000000))"), ("lineitem_quantity", "(l_quantity > 0)")]


def views(spark) -> K.Catalog:
    make = spark.createDataFrame
    return K.Catalog(
        make([("public", *r) for r in COLUMNS], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string, character_maximum_length int"),
        make([("public", n, "public", *r) for n, *r in CONSTRAINTS], "constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string"),
        make([("public", n, "public", *r) for n, *r in USAGE], "constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int"),
        make([("public", a, "public", b) for a, b in REFERENCES], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string"),
        make([("public", *r) for r in CHECKS], "constraint_schema string, constraint_name string, check_clause string"),
    )


def values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


WITH = f"""WITH col AS (SELECT * FROM {values(COLUMNS)} c(t, c, pos, type, nullable, dflt, len)), con AS (SELECT * FROM {values(CONSTRAINTS)} c(n, t, kind)), use AS (SELECT * FROM {values(USAGE)} c(n, t, c, pos, their)), ref AS (SELECT * FROM {values(REFERENCES)} c(n, key)),
fk AS (SELECT a.n, a.t, a.c, a.pos, b.t AS pt, b.c AS pc FROM use a JOIN ref ON ref.n = a.n JOIN use b ON b.n = ref.key AND b.pos = a.their),
own AS (SELECT use.t, use.n, con.kind, list(use.c ORDER BY use.pos) AS cs, list_sort(list(use.c)) AS ks FROM use JOIN con ON con.n = use.n WHERE con.kind IN ('PRIMARY KEY', 'UNIQUE') GROUP BY ALL)"""


@query(f"""{WITH}, f AS (SELECT n, t, pt, string_agg(c, ',' ORDER BY pos) AS cs, string_agg(pc, ',' ORDER BY pos) AS pcs, list_sort(list(c)) AS ks FROM fk GROUP BY n, t, pt)
SELECT n AS constraint_name, 'public' AS child_schema, t AS child_table, 'public' AS parent_schema, pt AS parent_table, cs AS columns, pcs AS parent_columns, CASE WHEN EXISTS (SELECT 1 FROM own WHERE own.t = f.t AND own.ks = f.ks) THEN '1:1' ELSE '1:N' END AS type, 1.0::DOUBLE AS confidence FROM f""")
def c_foreign_keys(spark, sf_dir):
    return K.foreign_keys(views(spark)).withColumns({c: F.array_join(c, ",") for c in ("columns", "parent_columns")})


@query(f"""{WITH} SELECT 'public' AS table_schema, t AS table_name, n AS constraint_name, kind AS constraint_type, array_to_string(cs, ',') AS columns FROM own""")
def c_keys(spark, sf_dir):
    return K.keys(views(spark), "PRIMARY KEY", "UNIQUE").withColumn("columns", F.array_join("columns", ","))


@query(f"""{WITH}, one AS (SELECT DISTINCT t, cs[1] AS c FROM own WHERE len(cs) = 1), k AS (SELECT t, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM own WHERE kind = 'PRIMARY KEY'), r AS (SELECT t, c, min(pt || '.' || pc) AS reference FROM fk GROUP BY 1, 2),
n AS (SELECT con.t, count(*) AS n FROM con WHERE kind = 'CHECK' GROUP BY 1)
SELECT col.t AS table_name, col.c AS column_name, pos AS ordinal_position, type AS data_type, nullable = 'YES' AS nullable, coalesce(k.i::VARCHAR, '') AS key_index, one.c IS NOT NULL AS is_unique, coalesce(reference, '') AS reference, coalesce(n.n, 0) AS n_checks
FROM col LEFT JOIN k ON k.t = col.t AND k.c = col.c LEFT JOIN one ON one.t = col.t AND one.c = col.c LEFT JOIN r ON r.t = col.t AND r.c = col.c LEFT JOIN n ON n.t = col.t""")
def c_columns(spark, sf_dir):
    out = K.described(views(spark))
    return out.select("table_name", "column_name", "ordinal_position", "data_type", "nullable", F.coalesce(F.col("key_index").cast("string"), F.lit("")).alias("key_index"), "is_unique", F.coalesce("reference", F.lit("")).alias("reference"), F.when(F.col("checks").isNull(), 0).otherwise(F.size("checks")).cast("long").alias("n_checks"))
