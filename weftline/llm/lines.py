"""Line dedup over overlapping three-line windows, in built-in functions only.

The lines of each row that have a word are hashed three in a row. A window that occurs anywhere before is a later occurrence; the lines
that later occurrences cover, merged, go. Before means: in a row with a smaller doc_id (null last), of rows with equal ids in the one
that the table lists first, or further up in the row itself. So the first copy of a passage stays, and two rows that share only one or
two lines lose nothing.

Rows are numbered and written once, so that rows with equal or no ids, repeated rows too, are told apart by the same number wherever
they are read. Windows are told apart by 128 bits of hash. They are counted with partial sums before the shuffle; the later places of a
window meet its first place by a join in which each window's first place is repeated for `SALTS` salts, so a window that stands in a
third of all rows is dealt to as many tasks, and those of its places that are most often in one task are split further by AQE. Only rows
that may lose lines are shuffled with their text (common.sift); the others pass.

Defined results: a null text stays null with no lines; blank lines are no part of a window, and one goes only if the lines with words
before and after it both go; trailing white space matters. Columns of docs that are called like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, sift

WINDOW = 3
SALTS = 16


def raw_lines() -> F.Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")


def has_word(line: F.Column) -> F.Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def windows(rows: DataFrame, width: int) -> DataFrame:
    """at (row order and place) and hash (two longs) of each window of lines of rows (__w_row, doc_id, text)."""
    lines = rows.where(F.col("text").isNotNull()).select("__w_row", F.col("doc_id").cast("long").alias("doc_id"), F.filter(raw_lines(), has_word).alias("lines"))
    lines = lines.select("__w_row", "doc_id", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(width), x).alias("b"))).alias("h")).where(F.size("h") >= width)

    def window(i):
        return F.struct(F.xxhash64(*[F.get("h", i + k)["a"] for k in range(width)]).alias("a"), F.xxhash64(*[F.get("h", i + k)["b"] for k in range(width)]).alias("b"))

    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__w_row", "place")
    return lines.select("__w_row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - width), window)).alias("place", "w")).select(at.alias("at"), "w.a", "w.b")


def later_windows(rows: DataFrame, width: int = WINDOW, salts: int = SALTS) -> DataFrame:
    """__w_of (a row) and __w_places: where windows start that occur before."""
    all_ = windows(rows, width)
    first = all_.groupBy("a", "b").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("a", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = all_.withColumn("salt", F.pmod(F.xxhash64("at.__w_row"), F.lit(salts)).cast("int"))
    later = salted.join(first, ["a", "b", "salt"]).where(F.col("at") > F.col("first"))
    return later.groupBy(F.col("at.__w_row").alias("__w_of")).agg(F.sort_array(F.collect_set("at.place")).alias("__w_places"))


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, others), its text without the lines that later windows cover, with n_lines and n_removed."""
    own = docs.drop("n_lines", "n_removed")
    rows = materialize(own.withColumn("__w_row", F.monotonically_increasing_id()), "rows")
    later = materialize(later_windows(rows.select("__w_row", "doc_id", "text"), width), "later")
    may, rest = sift(rows, "__w_row", later.select("__w_of"))
    both = may.join(later.hint("merge"), F.col("__w_row") == F.col("__w_of"), "left")
    # the covered lines by their number among lines with a word, then all lines from a covered one up to the next one if that is covered too
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("__w_places", lambda p: F.sequence(p, p + width - 1)))))
    d = both.withColumns({"__w_lines": raw_lines(), "__w_gone": F.coalesce(covered, F.array().cast("array<int>"))})
    d = d.withColumn("__w_full", F.filter(F.transform("__w_lines", lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull()))
    end = lambda g, i: F.when(F.get("__w_gone", i + 1) == g + 1, F.get("__w_full", g + 1) - 1).otherwise(F.get("__w_full", g))
    cut = F.flatten(F.transform("__w_gone", lambda g, i: F.sequence(F.get("__w_full", g), end(g, i))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__w_lines") - 1), cut)
    d = d.withColumn("__w_text", F.when(F.size("__w_gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__w_lines", i)), "\n")))
    edited = d.select(*[F.col("__w_text").alias("text") if c == "text" else F.col(c) for c in own.columns], F.size("__w_full").cast("long").alias("n_lines"), F.size("__w_gone").cast("long").alias("n_removed"))
    passed = rest.select(*own.columns, F.size(F.filter(raw_lines(), has_word)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return edited.unionByName(passed)
