"""The catalogue of registered queries over the star schema, and the SQL that any engine answers them with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog_queries as catalog_queries
from . import gen_queries as gen_queries
from . import hash_sql as X
from . import stream_queries as stream_queries
from .functions import draws as D
from .functions import hashing as H
from .functions.names import jaro_winkler, stem
from .operators import browse as B
from .operators import constraints as C
from .operators import discover, integrity, profile
from .operators.generate import adjust, fit_text, shard_ranges, unique_text
from .plans import depgraph, infer
from .registry import QUERIES as QUERIES
from .registry import SQL, query, t
from .sources.text import csv_line, insert_literal
from .spec import Constraints, Field, Relation, Table

# Keys and references of the star schema.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
RELATIONS = [
    Relation("nation", "region", fromField="n_regionkey", toField="r_regionkey"),
    Relation("customer", "nation", fromField="c_nationkey", toField="n_nationkey"),
    Relation("supplier", "nation", fromField="s_nationkey", toField="n_nationkey"),
    Relation("orders", "customer", fromField="o_custkey", toField="c_custkey"),
    Relation("lineitem", "orders", fromField="l_orderkey", toField="o_orderkey"),
    Relation("lineitem", "part", fromField="l_partkey", toField="p_partkey"),
    Relation("lineitem", "supplier", fromField="l_suppkey", toField="s_suppkey"),
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def report_sql(table: str, rules: dict[str, str]) -> str:
    """The SQL twin of constraints.report(): conditions under which each rule is broken."""
    every = {**rules, "*": " OR ".join(f"coalesce({c}, false)" for c in rules.values())}
    return " UNION ALL ".join("SELECT '{}' AS rule, count(*) AS checked, coalesce(sum(CASE WHEN {} THEN 1 ELSE 0 END), 0)::BIGINT AS violations FROM {}".format(n.replace("'", "''"), c, table) for n, c in every.items())


def rule_query(name: str, table: str, rules: Callable[[], list[C.Rule]], sql: dict[str, str]) -> None:
    """sql: for each rule's name, when it is broken. Rules are made on call, as columns need a session."""
    query(report_sql(table, sql), name)(lambda spark, sf_dir: C.report(t(spark, sf_dir, table), rules()))


def discount_ranges() -> list[C.Rule]:
    closed, open_ = C.number_range("l_discount", 0.02, 0.08), C.number_range("l_discount", 0.02, 0.08, exclusive=True)
    open_.name = "range:l_discount:exclusive"
    return [closed, open_]


# Validators: how many rows break each rule.
rule_query("v_range", "lineitem", discount_ranges, {"range:l_discount": "l_discount < 0.02 OR l_discount > 0.08", "range:l_discount:exclusive": "l_discount <= 0.02 OR l_discount >= 0.08"})
rule_query("v_length", "part", lambda: [C.length("p_name", 10, 20), C.length("p_type", None, 12)], {"length:p_name": "length(p_name) < 10 OR length(p_name) > 20", "length:p_type": "length(p_type) > 12"})
rule_query(
    "v_pattern", "customer", lambda: [C.pattern("c_name", "^Customer#[0-9]{9}$"), C.pattern("c_mktsegment", "^[A-M]")],
    {"pattern:c_name": "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')", "pattern:c_mktsegment": "NOT regexp_matches(c_mktsegment, '^[A-M]')"},
)
rule_query(
    "v_enum", "orders", lambda: [C.enum("o_orderstatus", ["F", "O"]), C.enum("o_orderpriority", ["1-URGENT", "2-HIGH"])],
    {"enum:o_orderstatus": "o_orderstatus NOT IN ('F', 'O')", "enum:o_orderpriority": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"},
)
rule_query("v_url", "pages", lambda: [C.url("url")], {"url:url": r"NOT regexp_matches(url, '(?i)^https?://[^\s/$.?#].[^\s]*$')"})
rule_query("v_required", "events", lambda: [C.required(c) for c in ("value", "props", "user_id")], {f"required:{c}": f"{c} IS NULL" for c in ("value", "props", "user_id")})
rule_query("v_multiple_of", "lineitem", lambda: [C.multiple_of("l_quantity", 5)], {"multipleOf:l_quantity": "abs(l_quantity / 5.0 - round(l_quantity / 5.0)) > 1e-9"})
rule_query(
    "v_percentage_of", "lineitem", lambda: [C.percentage_of("l_discount", "l_tax", "l_quantity", 1.0)],
    {"percentage_of:l_discount": "l_discount IS NOT NULL AND coalesce(abs(l_discount - (CASE WHEN l_quantity <> 0 THEN l_tax / l_quantity END) * 100.0) > 1.0, true)"},
)
rule_query(
    "v_ratio_of", "lineitem", lambda: [C.ratio_of("l_extendedprice", "l_quantity", "l_tax", 5000.0)],
    {"ratio_of:l_extendedprice": "l_extendedprice IS NOT NULL AND coalesce(abs(l_extendedprice - (CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END) * 1.0) > 5000.0, true)"},
)
rule_query(
    "v_conditional", "orders",
    lambda: [C.conditional("o_totalprice", C.condition("o_orderstatus", "eq", "F"), F.col("o_totalprice") > 100000.0, F.col("o_totalprice") <= 400000.0)],
    {"conditional:o_totalprice": "NOT coalesce(CASE WHEN coalesce(o_orderstatus = 'F', false) THEN o_totalprice > 100000 ELSE o_totalprice <= 400000 END, false)"},
)


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token FROM conversations)
SELECT count(*) AS n_tokens, coalesce(sum(CASE WHEN regexp_matches(token, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 1 ELSE 0 END), 0)::BIGINT AS n_emails, coalesce(sum(CASE WHEN regexp_matches(token, '(?i)^https?://[^\s/$.?#].[^\s]*$') THEN 1 ELSE 0 END), 0)::BIGINT AS n_urls FROM w
""")
def v_email(spark, sf_dir):
    words = t(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("token"))
    return words.agg(F.count("token").alias("n_tokens"), F.count_if(~C.email("token").broken).alias("n_emails"), F.count_if(~C.url("token").broken).alias("n_urls"))


@query("""
SELECT event_type, 'value' AS field, count(*) AS n_rows, count(*) - count(value) AS n_null, (count(*) - count(value))::DOUBLE / count(*) AS rate, (count(*) - count(value))::DOUBLE / count(*) > 0.05 AS violated FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'props', count(*), count(*) - count(props), (count(*) - count(props))::DOUBLE / count(*), (count(*) - count(props))::DOUBLE / count(*) > 0.05 FROM events GROUP BY event_type
""")
def v_null_rate(spark, sf_dir):
    return integrity.null_rates(t(spark, sf_dir, "events"), ["value", "props"], 0.05, by=["event_type"])


UNIQUE = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "documents": ["text"], "conversations": ["conv_id"], "pages": ["url"]}


@query(" UNION ALL ".join(
    f"SELECT '{table}' AS \"table\", '{'+'.join(cols)}' AS field, coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) AS n_values, coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n_repeated, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS n_violating "
    f"FROM (SELECT count(*) AS n FROM {table} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)} GROUP BY {', '.join(cols)})"
    for table, cols in UNIQUE.items()
))
def v_unique(spark, sf_dir):
    out = None
    for table, cols in UNIQUE.items():
        df = t(spark, sf_dir, table)
        by = cols
        if cols == ["text"]:  # long texts are told apart by 128 bits of hash, so the shuffle carries no text
            df, by = df.where("text is not null").select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")), ["a", "b"]
        row = integrity.uniqueness(df, by).select(F.lit(table).alias("table"), F.lit("+".join(cols)).alias("field"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def lines_with_orders(spark, sf_dir) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    return lines.join(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))


OPS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@query(report_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", {f"{k}:l_shipdate": f"NOT (l_shipdate {o} o_orderdate)" for k, o in OPS.items()}))
def v_cross(spark, sf_dir):
    return C.report(lines_with_orders(spark, sf_dir), [C.compare("l_shipdate", op, "o_orderdate") for op in OPS])


@query(report_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", {
    "before:l_shipdate": "l_shipdate IS NOT NULL AND NOT coalesce(l_shipdate < o_orderdate, false)",
    "after:l_shipdate": "l_shipdate IS NOT NULL AND NOT coalesce(l_shipdate > o_orderdate, false)",
    "within_days:l_shipdate": "l_shipdate IS NOT NULL AND NOT coalesce(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) <= 120 * 86400000000, false)",
    "older_than:o_orderdate": "o_orderdate IS NOT NULL AND NOT coalesce(o_orderdate::DATE <= DATE '1999-01-01' - INTERVAL 60 MONTH, false)",
}))
def v_temporal(spark, sf_dir):
    rules = [C.temporal("l_shipdate", "before", "o_orderdate"), C.temporal("l_shipdate", "after", "o_orderdate"), C.temporal("l_shipdate", "within_days", "o_orderdate", 120), C.temporal("o_orderdate", "older_than", "1999-01-01", 5)]
    return C.report(lines_with_orders(spark, sf_dir), rules)


CHARGE = "CAST(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,4)) AS DECIMAL(18,4))"


@query(f"""
WITH s AS (SELECT l_orderkey, sum({CHARGE})::DOUBLE AS charge FROM lineitem GROUP BY 1)
SELECT count(*) AS checked, sum(CASE WHEN abs(o_totalprice - coalesce(charge, 0)) > 1000 THEN 1 ELSE 0 END)::BIGINT AS violations FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""")
def v_sum_of(spark, sf_dir):
    charge = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr(CHARGE)).cast("double").alias("charge"))
    both = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(charge, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return C.report(both, [C.sum_of("o_totalprice", ["charge"], 1000.0)]).where("rule <> '*'").select("checked", "violations")


@query(report_sql("(SELECT CASE WHEN l_discount > 0.05 THEN l_discount END AS a, CASE WHEN l_tax > 0.04 THEN l_tax END AS b, CASE WHEN l_quantity > 40 THEN l_quantity END AS c FROM lineitem)", {"exclusive:a": "a IS NOT NULL AND (b IS NOT NULL OR c IS NOT NULL)", "exclusive:b": "b IS NOT NULL AND a IS NOT NULL"}))
def v_mutex(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select(F.expr("CASE WHEN l_discount > 0.05 THEN l_discount END AS a"), F.expr("CASE WHEN l_tax > 0.04 THEN l_tax END AS b"), F.expr("CASE WHEN l_quantity > 40 THEN l_quantity END AS c"))
    return C.report(df, [C.mutually_exclusive("a", ["b", "c"]), C.mutually_exclusive("b", ["a"])])


def total_in_range() -> C.Rule:
    return C.number_range("o_totalprice", 1000, 300000)


def known_status() -> C.Rule:
    return C.enum("o_orderstatus", ["F", "O"])


rule_query(
    "v_report", "orders", lambda: [total_in_range(), known_status(), C.pattern("o_orderpriority", "^[1-3]-"), C.temporal("o_orderdate", "after", "1993-01-01")],
    {
        "range:o_totalprice": "o_totalprice < 1000 OR o_totalprice > 300000",
        "enum:o_orderstatus": "o_orderstatus NOT IN ('F', 'O')",
        "pattern:o_orderpriority": "NOT regexp_matches(o_orderpriority, '^[1-3]-')",
        "after:o_orderdate": "o_orderdate IS NOT NULL AND NOT coalesce(o_orderdate > TIMESTAMP '1993-01-01', false)",
    },
)


DECLARED = Table("orders", [Field("o_orderkey", "long", True, primaryKey=True), Field("o_custkey", "integer", constraints=Constraints(unique=True)), Field("o_orderstatus", constraints=Constraints(enum=["F", "O"])), Field("o_totalprice", "float", constraints=Constraints(min=1000, nullPercentage=0))])


@query("""
WITH s(rule, violations) AS (SELECT 'required:o_orderkey', count(*) FROM orders WHERE o_orderkey IS NULL UNION ALL SELECT 'unique_set:o_custkey', count(*) FROM orders WHERE o_custkey IS NULL
UNION ALL SELECT 'enum:o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'range:o_totalprice', count(*) FROM orders WHERE o_totalprice < 1000
UNION ALL SELECT '*', count(*) FROM orders WHERE coalesce(o_orderstatus NOT IN ('F', 'O'), false) OR coalesce(o_totalprice < 1000, false) OR o_orderkey IS NULL OR o_custkey IS NULL
UNION ALL SELECT 'unique:o_orderkey', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) WHERE n > 1 UNION ALL SELECT 'unique:o_custkey', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 1
UNION ALL SELECT 'null_rate:o_totalprice', CASE WHEN count(*) > count(o_totalprice) THEN 1 ELSE 0 END FROM orders)
SELECT rule, (SELECT count(*) FROM orders) AS checked, violations::BIGINT AS violations FROM s""")
def v_table(spark, sf_dir):
    """All that a declared table implies: rules of rows, keys, unique fields, null shares."""
    return C.table_report(t(spark, sf_dir, "orders"), DECLARED)


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 1000.0 WHEN o_totalprice > 300000 THEN 300000.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def v_correct(spark, sf_dir):
    return C.correct(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), [total_in_range(), known_status()])


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 1000 OR o_totalprice > 300000 THEN 'range:o_totalprice' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'enum:o_orderstatus' END) AS rules FROM orders
WHERE o_totalprice < 1000 OR o_totalprice > 300000 OR o_orderstatus NOT IN ('F', 'O')
""")
def v_rows(spark, sf_dir):
    found = C.validate(t(spark, sf_dir, "orders"), [total_in_range(), known_status()])
    return found.where(F.size("_violations") > 0).select("o_orderkey", F.array_join(F.transform("_violations", lambda v: v["rule"]), ",").alias("rules"))


# Integrity across tables.
@query(" UNION ALL ".join(
    f"SELECT '{r.fromTable}.{r.fromField}' AS relation, '{r.toTable}' AS parent, count(*) AS n_checked, count(*) - count({r.fromField}) AS n_null, coalesce(sum(CASE WHEN {r.fromField} IS NOT NULL AND {r.fromField} NOT IN (SELECT {r.toField} FROM {r.toTable}) THEN 1 ELSE 0 END), 0)::BIGINT AS n_orphans FROM {r.fromTable}"
    for r in [*RELATIONS, Relation("events", "customer", fromField="user_id", toField="c_custkey")]
))
def i_orphans(spark, sf_dir):
    relations = [*RELATIONS, Relation("events", "customer", fromField="user_id", toField="c_custkey")]
    names = {r.fromTable for r in relations} | {r.toTable for r in relations}
    return integrity.reference_report({n: t(spark, sf_dir, n) for n in names}, relations)


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def i_orphan_rows(spark, sf_dir):
    return integrity.orphans(t(spark, sf_dir, "events"), t(spark, sf_dir, "customer"), ["user_id"], ["c_custkey"]).select("event_id", "user_id")


@query("""
SELECT l_orderkey, count(*) AS n, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity, sum(l_quantity::DECIMAL(12,2))::DOUBLE / count(*) AS average, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1 HAVING count(*) > 6 OR sum(l_quantity::DECIMAL(12,2)) > 200
""")
def i_groups(spark, sf_dir):
    q = F.col("l_quantity").cast("decimal(12,2)")
    sums = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(q).cast("double").alias("quantity"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return sums.where("n > 6 or quantity > 200").select("l_orderkey", "n", "quantity", (F.col("quantity") / F.col("n")).alias("average"), "least", "most")


def each_cross(kind: str, value: str) -> str:
    return f"SELECT '{kind}' AS kind, o_orderkey, value FROM orders LEFT JOIN (SELECT l_orderkey, round({value}, 6)::DOUBLE AS value FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE NOT coalesce(value < {LIMITS[kind]}, false)"


LIMITS = {"sum": 250, "avg": 40, "min": 30, "max": 50, "stddev": 18}


@query(" UNION ALL ".join(each_cross(k, v) for k, v in {"sum": "sum(l_quantity)", "avg": "avg(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "stddev": "stddev_samp(l_quantity)"}.items()))
def i_cross_table(spark, sf_dir):
    """Orders whose lines' totals break a limit, for each aggregate; an order without lines has none and breaks it too."""
    orders, lines = t(spark, sf_dir, "orders").select("o_orderkey"), t(spark, sf_dir, "lineitem")
    parts = [integrity.cross_table(orders, "o_orderkey", lines, "l_orderkey", k, "l_quantity", F.round("value", 6) < F.lit(most)).select(F.lit(k).alias("kind"), "o_orderkey", F.round(F.col("value").cast("double"), 6).alias("value")) for k, most in LIMITS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE NOT coalesce(n, 0) BETWEEN 1 AND 15
""")
def i_cross_count(spark, sf_dir):
    out = integrity.cross_table(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", t(spark, sf_dir, "orders"), "o_custkey", "count", F.lit(1), "n_orders between 1 and 15", "n_orders")
    return out.select("c_custkey", "n_orders")


@query("SELECT l_returnflag, l_linestatus, round(stddev_samp(l_quantity), 4) AS value FROM lineitem GROUP BY 1, 2 HAVING NOT coalesce(stddev_samp(l_quantity) < 14.4, false)")
def i_aggregation(spark, sf_dir):
    return integrity.aggregation(t(spark, sf_dir, "lineitem"), "stddev", "l_quantity", ["l_returnflag", "l_linestatus"], "value < 14.4").withColumn("value", F.round("value", 4))


@query("SELECT o_custkey, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING NOT max(o_totalprice) < 350000")
def i_having(spark, sf_dir):
    return integrity.aggregation(t(spark, sf_dir, "orders"), "max", "o_totalprice", ["o_custkey"], "value < 350000", where="o_orderstatus = 'O'")


# Discovery.
DISCOVERED = {"nation": ["n_regionkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["user_id"]}
PAIRS = [discover.Candidate(child, c, parent, key) for child, cols in DISCOVERED.items() for c in cols for parent, key in KEYS.items() if parent != child]


def overlap_sql() -> str:
    one = "SELECT '{c}' AS child, '{f}' AS field, '{p}' AS parent, (SELECT count({f}) FROM {c}) AS n_valid, (SELECT count(*) FROM {c} WHERE {f} IN (SELECT {k} FROM {p})) AS n_matched, (SELECT count(DISTINCT {f}) FROM {c} WHERE {f} IN (SELECT {k} FROM {p})) AS n_distinct, (SELECT count(DISTINCT {k}) FROM {p}) AS n_keys"
    rows = " UNION ALL ".join(one.format(c=p.child, f=p.column, p=p.parent, k=p.key) for p in PAIRS)
    return f"SELECT *, n_matched::DOUBLE / n_valid AS accuracy, n_distinct::DOUBLE / n_keys AS coverage FROM ({rows})"


def overlaps(spark, sf_dir) -> DataFrame:
    return discover.overlap({n: t(spark, sf_dir, n) for n in {*DISCOVERED, *KEYS}}, PAIRS)


query(overlap_sql(), "d_overlap")(overlaps)
def bare(column: str) -> str:
    """A column's name without the letter of its table."""
    return column[2:] if column[1] == "_" else column


def similarity_sql(a: str, b: str) -> str:
    """jaro_winkler() in another engine's terms."""
    prefix = " + ".join(f"CASE WHEN length({a}) >= {k} AND {a}[1:{k}] = {b}[1:{k}] THEN 1 ELSE 0 END" for k in range(1, 5))
    near = f"(jaro_similarity({a}, {b}) + CASE WHEN jaro_similarity({a}, {b}) > 0 THEN ({prefix}) * 0.1 * (1 - jaro_similarity({a}, {b})) ELSE 0 END)"
    held = f"least(0.85 + 0.15 * least(length({a}), length({b})) / greatest(length({a}), length({b})), 1.0)"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN {held} ELSE {near} END::DOUBLE"


STEMS = {(p.column, p.parent): (stem(bare(p.column)), stem(p.parent)) for p in PAIRS}
STEMS_SQL = f"SELECT field, parent, {similarity_sql('a', 'b')} AS similarity FROM (VALUES " + ", ".join(f"('{c}', '{p}', '{a}', '{b}')" for (c, p), (a, b) in STEMS.items()) + ") n(field, parent, a, b)"


def similar(spark) -> DataFrame:
    return spark.createDataFrame([(c, p, jaro_winkler(a, b)) for (c, p), (a, b) in STEMS.items()], "field string, parent string, similarity double")


@query(f"SELECT field, parent, round(similarity, 9) AS similarity FROM ({STEMS_SQL})")
def d_similarity(spark, sf_dir):
    return similar(spark).withColumn("similarity", F.round("similarity", 9))


@query(f"""
WITH o AS ({overlap_sql()}), n AS ({STEMS_SQL})
SELECT child, o.field, o.parent, floor((least(coverage, 1.0) * 0.40 + similarity * 0.25 + 0.0 * 0.20 + (1.0 - least((1.0 - accuracy) * 100 / 100, 1.0)) * 0.10 + 1.0 * 0.15) * (1.0 - 0.0 * 0.3) * 100 + 0.5) / 100 AS confidence
FROM o JOIN n ON n.field = o.field AND n.parent = o.parent
""")
def d_score(spark, sf_dir):
    both = overlaps(spark, sf_dir).join(similar(spark), ["field", "parent"])
    score = discover.confidence(F.col("coverage"), F.col("similarity"), F.lit(False), (F.lit(1.0) - F.col("accuracy")) * 100, F.lit(True), F.lit(0.0))
    return both.select("child", "field", "parent", score.alias("confidence"))


@query(f"SELECT child, field, parent, CASE WHEN 1.0 - n_distinct::DOUBLE / n_keys > 0.5 THEN '1:N' ELSE '1:1' END AS cardinality FROM ({overlap_sql()})")
def d_cardinality(spark, sf_dir):
    return overlaps(spark, sf_dir).select("child", "field", "parent", discover.cardinality(F.col("n_distinct"), F.col("n_keys"), F.lit(False)).alias("cardinality"))


# Columns named as a foreign schema would name them, so that names and values both speak.
RENAMED = {"customer": {"c_custkey": "id", "c_nationkey": "nation_id"}, "nation": {"n_nationkey": "id", "n_regionkey": "region_id"}, "region": {"r_regionkey": "id"}, "orders": {"o_orderkey": "id", "o_custkey": "customer_id"}, "events": {"event_id": "id", "user_id": "customerId"}}


def discover_sql() -> str:
    """For each column called like a reference to a table: overlap, and the score by hand. An exact name with an ending has all of the names' evidence."""
    told = [("customer", "c_nationkey", "nation", "n_nationkey", "nation_id"), ("nation", "n_regionkey", "region", "r_regionkey", "region_id"), ("orders", "o_custkey", "customer", "c_custkey", "customer_id"), ("events", "user_id", "customer", "c_custkey", "customerId")]
    one = "SELECT '{p}' AS \"parentTable\", '{c}' AS \"childTable\", '{name}' AS \"column\", (SELECT count({f}) FROM {c}) AS n_valid, (SELECT count(*) FROM {c} WHERE {f} IN (SELECT {k} FROM {p})) AS n_matched, (SELECT count(DISTINCT {f}) FROM {c} WHERE {f} IN (SELECT {k} FROM {p})) AS n_distinct, (SELECT count(*) FROM {p}) AS n_keys"
    rows = " UNION ALL ".join(one.format(c=c, f=f, p=p, k=k, name=n) for c, f, p, k, n in told)
    return f"""
SELECT "parentTable", "childTable", "column", 1.0::DOUBLE AS confidence, CASE WHEN 1.0 - n_distinct::DOUBLE / n_matched > 0.5 THEN '1:N' ELSE '1:1' END AS type, false AS "isArrayReference", n_matched::DOUBLE / n_valid AS accuracy, n_distinct::DOUBLE / n_keys AS coverage,
floor((least(n_distinct::DOUBLE / n_keys, 1.0) * 0.40 + 1.0 * 0.25 + 1.0 * 0.20 + (1.0 - least((1.0 - n_matched::DOUBLE / n_valid) * 100 / 100, 1.0)) * 0.10 + 1.0 * 0.15) * 100 + 0.5) / 100 AS score
FROM ({rows}) WHERE n_valid > 0 AND n_matched::DOUBLE / n_valid >= 0.5"""


@query(discover_sql())
def d_discover(spark, sf_dir):
    return discover.discover({n: t(spark, sf_dir, n).withColumnsRenamed(m) for n, m in RENAMED.items()}, dict.fromkeys(RENAMED, "id"))


DOCUMENTS = """select 'talks/' || conv_id || '/turns/' || turn as path, '{"by": {"path": "people/' || turn || '"}, "tags": [{"path": "labels/1"}, {"path": "labels/2"}], "odd": {"path": "alone"}, "n": ' || turn || CASE WHEN role = 'user' THEN ', "site": {"path": "/places/x/rooms/y"}' ELSE '' END || '}' as data"""


@query(f"""
WITH d AS ({DOCUMENTS} FROM conversations), p AS (SELECT string_split(path, '/') AS p, data FROM d), m AS (SELECT p[len(p) - 1] AS child, unnest(json_keys(data)) AS key, data FROM p),
v AS (SELECT child, key, json_type(json_extract(data, '$.' || key)) = 'ARRAY' AS many, coalesce(json_extract_string(data, '$.' || key || '.path'), json_extract_string(data, '$.' || key || '[0].path')) AS path FROM m)
SELECT DISTINCT string_split(trim(path, '/'), '/')[1] AS "parentTable", child AS "childTable", key AS "column", 1.0::DOUBLE AS confidence, CASE WHEN many THEN 'N:M' ELSE '1:N' END AS type, many AS "isArrayReference" FROM v WHERE len(string_split(trim(path, '/'), '/')) >= 2
UNION ALL SELECT DISTINCT p[len(p) - 3], p[len(p) - 1], '_parent', 1.0::DOUBLE, '1:N', false FROM p WHERE len(p) >= 4""")
def d_paths(spark, sf_dir):
    """References and subcollections that documents declare by their paths."""
    return discover.by_paths(t(spark, sf_dir, "conversations").selectExpr(*[x for x in (DOCUMENTS[7:].split(" as path, ")[0] + " as path", DOCUMENTS[7:].split(" as path, ")[1])]), "path", "data")


# Profiles.
@query("""
WITH m AS (SELECT unnest(json_keys(props)) AS key, props FROM events),
v AS (SELECT key, CASE json_type(props, '$."' || key || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type FROM m),
c AS (SELECT key, type, count(*) AS n FROM v GROUP BY 1, 2)
SELECT key, type, n, row_number() OVER (PARTITION BY key ORDER BY type = 'null', n DESC, type) = 1 AS dominant FROM c
""")
def p_types(spark, sf_dir):
    return profile.type_histogram(t(spark, sf_dir, "events"), "props")


LISTS = """'{"turns": [' || turn || ', {"n": ' || turn || '}], "roles": ["' || role || '"], "parts": [{"t": 1}], "none": []}'"""


@query(f"""
WITH d AS (SELECT {LISTS} AS j FROM conversations), k AS (SELECT unnest(json_keys(j)) AS key, j FROM d), e AS (SELECT key, unnest(CAST(json_extract(j, '$.' || key) AS JSON[])) AS item FROM k)
SELECT k.key, CASE WHEN coalesce(o AND p, false) THEN 'mixed' WHEN o THEN 'object' ELSE 'primitive' END AS items FROM (SELECT DISTINCT key FROM k) k
LEFT JOIN (SELECT key, bool_or(json_type(item) = 'OBJECT') AS o, bool_or(json_type(item) <> 'OBJECT') AS p FROM e GROUP BY 1) x ON x.key = k.key""")
def p_item_types(spark, sf_dir):
    return profile.item_types(t(spark, sf_dir, "conversations").select(F.expr(LISTS).alias("j")), "j")


TEXTS = ["c_name", "c_mktsegment"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS n, n_numeric::DOUBLE / count({c}) AS numeric_ratio, 0.0::DOUBLE AS uuid_ratio, n_numeric::DOUBLE / count({c}) > 0.8 AS is_numeric, false AS is_uuid, sum(length({c}))::DOUBLE / count({c}) AS average_length FROM customer, (SELECT count(*) AS n_numeric FROM customer WHERE regexp_matches({c}, '^-?[0-9]+\\.?[0-9]*$')) GROUP BY n_numeric"
    for c in TEXTS
))
def p_value_type(spark, sf_dir):
    return profile.value_types(t(spark, sf_dir, "customer"), TEXTS)


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}" for n in TABLES))
def p_stats(spark, sf_dir):
    return profile.sizes({n: t(spark, sf_dir, n) for n in TABLES})


@query("SELECT \"table\", n_rows, CASE WHEN n_rows < 1000 THEN n_rows WHEN n_rows <= 100000 THEN greatest(100, n_rows // 100) ELSE greatest(1000, n_rows // 1000) END AS n_sample FROM (" + SQL["p_stats"] + ")")
def p_sample_size(spark, sf_dir):
    return p_stats(spark, sf_dir).withColumn("n_sample", profile.sample_size(F.col("n_rows")))


# Browsing.
@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def b_browse(spark, sf_dir):
    return B.browse(t(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, skip=100, limit=50, order_by=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)")
def b_filter(spark, sf_dir):
    return t(spark, sf_dir, "customer").where(B.matching({"c_mktsegment": "BUILDING", "c_nationkey": [1, 2, 3]})).select("c_custkey", "c_name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def b_update(spark, sf_dir):
    return B.update(t(spark, sf_dir, "supplier"), {"s_suppkey": 3}, {"s_name": "renamed", "s_acctbal": 0.0}).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <> 3")
def b_delete(spark, sf_dir):
    return B.delete(t(spark, sf_dir, "supplier"), {"s_suppkey": 3}).select("s_suppkey", "s_name")


@query("SELECT max(o_orderkey) + 1 AS next_id FROM orders")
def b_next_key(spark, sf_dir):
    return B.next_key(t(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT e.event_id FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer)")
def b_existing(spark, sf_dir):
    return B.existing(t(spark, sf_dir, "events"), "user_id", t(spark, sf_dir, "customer"), "c_custkey").select("event_id")


# Generation, with hashes that both engines can compute.
FNV_SQL = "list_reduce(list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261)"


def uuid_sql(base: str) -> str:
    d = " || ".join("lpad(to_hex({}), 8, '0')".format(FNV_SQL.format(s=f"{base} || '_{k}'")) for k in range(1, 5))
    return f"lower({d})"


@query(f"SELECT o_orderkey, {FNV_SQL.format(s="'orders_' || o_orderkey || '_42'")} AS hash FROM orders")
def g_fnv1a(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", H.fnv1a(H.joined("orders", F.col("o_orderkey"), 42)).alias("hash"))


@query(f"SELECT s_suppkey, d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] AS uuid FROM (SELECT s_suppkey, {uuid_sql("('supplier_' || s_suppkey || '_42')")} AS d FROM supplier)")
def g_fnv_uuid(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", H.fnv_uuid(H.joined("supplier", F.col("s_suppkey"), 42)).alias("uuid"))


@query(f"SELECT s_suppkey, {uuid_sql("('supplier_' || s_suppkey || '_42')")}[1:24] AS object_id FROM supplier")
def g_fnv_objectid(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", H.fnv_object_id(H.joined("supplier", F.col("s_suppkey"), 42)).alias("object_id"))


@query("WITH p AS (SELECT count(*) AS n FROM customer) SELECT i + 1 AS id, i % p.n + 1 AS customer_id, c.c_custkey IS NOT NULL AS found FROM range(5000) r(i) CROSS JOIN p LEFT JOIN customer c ON c.c_custkey = i % p.n + 1")
def g_modulo_fk(spark, sf_dir):
    parents = t(spark, sf_dir, "customer")
    n = parents.count()
    child = spark.range(5000).select((F.col("id") + 1).alias("id"), (F.pmod("id", F.lit(n)) + 1).alias("customer_id"))
    own = parents.select("c_custkey", F.lit(True).alias("found"))
    return child.join(own, F.col("customer_id") == F.col("c_custkey"), "left").select("id", "customer_id", F.coalesce("found", F.lit(False)).alias("found"))


@query('SELECT "table", w AS worker, w * (n_rows // 4) + least(w, n_rows % 4) AS start, n_rows // 4 + CASE WHEN w < n_rows % 4 THEN 1 ELSE 0 END AS n FROM (' + SQL["p_stats"] + ") CROSS JOIN range(4) r(w) WHERE n_rows // 4 + CASE WHEN w < n_rows % 4 THEN 1 ELSE 0 END > 0")
def g_shards(spark, sf_dir):
    return shard_ranges(p_stats(spark, sf_dir), "n_rows", 4).select("table", "worker", "start", "n")


def gen(spark, sf_dir):
    """Row indices of orders, for draws over them."""
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def u_sql(field: str, draw: int = 0) -> str:
    return X.uniform(42, "orders", field, "o_orderkey", draw)


def u(field: str, draw: int = 0):
    return H.uniform(42, "orders", field, F.col("id"), draw=draw)


@query(f"""
SELECT o_orderkey AS id, ['new', 'paid', 'sent'][floor(({u_sql("status")}) * 3.0)::INT + 1] AS e, CASE WHEN {u_sql("note", 1)} < 0.2 THEN NULL ELSE 'x' END AS nullable, {u_sql("flag")} > 0.5 AS b,
floor(({u_sql("qty")}) * 91.0)::BIGINT + 10 AS i, ({u_sql("price")}) * 90.0 + 10.0 AS x, make_timestamp((1704067200000 + floor(({u_sql("at")}) * 31536000000.0)::BIGINT) * 1000) AS at FROM orders
""")
def g_values(spark, sf_dir):
    at = F.timestamp_millis(F.lit(1704067200000) + F.floor(u("at") * 31536000000.0)).cast("timestamp_ntz")
    return gen(spark, sf_dir).select("id", D.pick(u("status"), ["new", "paid", "sent"]).alias("e"), F.when(u("note", 1) < 0.2, F.lit(None)).otherwise("x").alias("nullable"), (u("flag") > 0.5).alias("b"), D.integer(u("qty"), 10, 100).alias("i"), D.number(u("price"), 10, 100).alias("x"), at.alias("at"))


ZIPF_SQL = "SELECT k, sum(1.0 / pow(k, 1.2)) OVER (ORDER BY k) / sum(1.0 / pow(k, 1.2)) OVER () AS upto FROM range(1, 101) r(k)"


@query(f"""
SELECT o_orderkey AS id, round(sqrt(-2.0 * ln(1.0 - {u_sql("n", 0)})) * cos(6.283185307179586 * ({u_sql("n", 1)})) * 2.0 + 10.0, 6) AS normal, round(-ln(1.0 - {u_sql("e")}) / 0.5, 6) AS exponential FROM orders
""")
def g_normal(spark, sf_dir):
    return gen(spark, sf_dir).select("id", F.round(D.normal(u("n", 0), u("n", 1), 10, 2), 6).alias("normal"), F.round(D.exponential(u("e"), 0.5), 6).alias("exponential"))


@query(f"WITH z AS ({ZIPF_SQL}) SELECT o.id, (SELECT count(*) FROM z WHERE upto < o.u) + 1 AS rank FROM (SELECT o_orderkey AS id, {u_sql('z')} AS u FROM orders) o")
def g_zipf(spark, sf_dir):
    return gen(spark, sf_dir).select("id", D.zipf(u("z"), 100, 1.2).alias("rank"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS lo, l_quantity + 20 AS hi, l_tax * 1000 AS v FROM lineitem),
b AS (SELECT *, CASE WHEN v < lo THEN lo + abs(v) ELSE v END AS v1 FROM a), c AS (SELECT *, CASE WHEN v1 <= lo THEN lo + greatest(1.0, abs(v1)) ELSE v1 END AS v2 FROM b),
d AS (SELECT *, CASE WHEN v2 > hi THEN CASE WHEN hi > lo THEN lo + (abs(v2) % (hi - lo)) ELSE hi END ELSE v2 END AS v3 FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN v3 >= hi THEN CASE WHEN hi > lo THEN lo + (abs(v3) % (hi - lo)) ELSE hi - 1 END ELSE v3 END AS v FROM d
""")
def g_cross_adjust(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 20).alias("hi"), (F.col("l_tax") * 1000).alias("v"))
    return df.select("l_orderkey", "l_linenumber", adjust(F.col("v"), low=F.col("lo"), above=F.col("lo"), high=F.col("hi"), below=F.col("hi"), floor=F.col("lo")).alias("v"))


@query("""
SELECT c_custkey, left(c_name, 12 - length('_' || c_custkey)) || '_' || c_custkey AS name, lower(c_mktsegment) || '_' || c_custkey || '@x.test' AS mail,
CASE WHEN length(c_mktsegment) < 16 THEN left(c_mktsegment || repeat(' extra', 3), 16) ELSE c_mktsegment END AS padded FROM customer
""")
def g_text(spark, sf_dir):
    df = t(spark, sf_dir, "customer")
    mail = unique_text(F.concat(F.lower("c_mktsegment"), F.lit("@x.test")), F.col("c_custkey"))
    return df.select("c_custkey", unique_text(F.col("c_name"), F.col("c_custkey"), 12).alias("name"), mail.alias("mail"), fit_text(F.col("c_mktsegment"), 16, 16).alias("padded"))


# Text forms of rows.
@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang || ',' || n_chars AS line FROM documents
""")
def x_csv_line(spark, sf_dir):
    df = t(spark, sf_dir, "documents")
    return df.select("doc_id", csv_line(df.select("text", "lang", "n_chars")).alias("line"))


@query("SELECT c_custkey, 'INSERT INTO customer (c_custkey, c_name, c_nationkey) VALUES (' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ' || coalesce(c_nationkey::VARCHAR, 'NULL') || ');' AS statement FROM customer")
def x_insert_literal(spark, sf_dir):
    df = t(spark, sf_dir, "customer")
    return df.select("c_custkey", insert_literal("customer", df.select("c_custkey", "c_name", "c_nationkey")).alias("statement"))


# Plans.
def infer_sql() -> str:
    rules = ", ".join("({}, '{}', {}, {}::DOUBLE, {})".format(k, r.generator, [*r.tokens], float(r.score), [*r.veto] or "[]::VARCHAR[]") for k, r in enumerate(infer.RULES))
    fields = ", ".join("('{}', {})".format(n, infer.tokens(n)) for n in infer.SAMPLE_FIELDS)
    return f"""
WITH r(no, generator, need, score, veto) AS (VALUES {rules}), f(field, tok) AS (VALUES {fields}),
s AS (SELECT field, no, generator, score + CASE WHEN len(need) = len(tok) THEN 5 ELSE -0.5 * greatest(len(tok) - len(need), 0) END AS score FROM f JOIN r ON list_has_all(tok, need) AND NOT list_has_any(tok, veto))
SELECT field, generator, score FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, no) AS k FROM s) WHERE k = 1"""


@query(infer_sql())
def r_infer_score(spark, sf_dir):
    return infer.score_table(spark, infer.SAMPLE_FIELDS)


EDGES = depgraph.relation_edges(RELATIONS)


@query(f"""
WITH RECURSIVE e(child, parent) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in EDGES)}), walk(name, level) AS (SELECT DISTINCT parent, 0 FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, walk.level + 1 FROM walk JOIN e ON e.parent = walk.name)
SELECT name, max(level) AS level FROM walk GROUP BY name
""")
def r_levels(spark, sf_dir):
    return depgraph.recursive_levels(spark, EDGES)
