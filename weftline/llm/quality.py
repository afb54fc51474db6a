"""Quality rules: a table of thresholds compiled into projections of built-in functions.

RULES says what is measured, between which bounds it must lie, and from how many words on the rule holds. compile_rules() turns the
table into one boolean column over the measures of measure(); no user function runs, and no row meets another.

Words are [^\\x20\\x09-\\x0D]+ of the whole text. Windows of five words are compared by 64-bit hashes of their words' hashes.

The counts, some numbers a row, are written once (common.materialize), so later joins and filters neither copy the expressions behind
them nor plan over these.

Defined results: null and blank texts have no words and fail the base rule; ratios without a denominator are null and pass.
Rows are independent of each other; other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Frequent function words.
STOP_WORDS = sorted(set(
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no a "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei in "
    "le la les de des du et un une est en que qui dans il pour pas au sur ne se ce par plus je avec tout faire son mais comme ou si leur y dit elle deux ces lui nous bien aux où "
    "el los las y del que con por una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está no se un".split()
))


class Rule(NamedTuple):
    name: str
    measure: str
    least: float | None
    most: float | None
    from_words: int = 0


RULES = (
    Rule("mean word length", "mean_word_length", 2.0, 15.0),
    Rule("symbols in words", "symbol_ratio", None, 0.05),
    Rule("stop words", "stop_ratio", 0.04, None, 40),
    Rule("repeated lines", "dup_line_ratio", None, 0.4),
    Rule("words a line", "words_per_line", 2.0, None, 40),
)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> F.Column:
    """True where every rule holds; a null measure passes."""
    out = F.lit(True)
    for r in rules:
        holds = F.lit(True)
        if r.least is not None:
            holds &= F.col(r.measure) >= r.least
        if r.most is not None:
            holds &= F.col(r.measure) <= r.most
        out &= F.coalesce(holds | (F.col("n_words") < r.from_words), F.lit(True))
    return out


#: Numerator and denominator of each measure.
MEASURES = {"mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"), "stop_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "words_per_line": ("n_words", "n_lines")}


def sql(rule: Rule) -> str:
    """A rule as an SQL condition over the counts."""
    a, b = MEASURES[rule.measure]
    bounds = [f"{a}::DOUBLE / nullif({b}, 0) {op} {v}" for op, v in ((">=", rule.least), ("<=", rule.most)) if v is not None]
    return f"coalesce(({' AND '.join(bounds)}) OR n_words < {rule.from_words}, true)"


def ratio(a: str, b: str) -> F.Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def covered(hashes: F.Column, width: int) -> F.Column:
    """Places that lie in a window whose hash occurs at least twice among `hashes`, a window starting at each place."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        again = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def total(at):
        return F.aggregate(at, F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n")), lambda acc: acc["n"])

    # each transform over a one-element array names a value, so that it is computed once
    return F.get(F.transform(F.transform(F.array(marked), places), total), 0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    d = docs.select("doc_id", text.alias("text"), F.btrim(text, F.lit(BLANKS)).alias("trimmed"))
    d = d.select(
        "doc_id",
        F.when(F.length("trimmed") > 0, F.split("trimmed", "[\\x20\\x09-\\x0D]+")).otherwise(none).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("lines"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    d = d.withColumn("h", F.when(F.size("h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeated = F.when(F.size(F.array_distinct("h")) < F.size("h"), covered(F.col("h"), WINDOW)).otherwise(F.lit(0)).cast("long")
    d = materialize(d.withColumn("n_repeat_words", repeated).drop("h"), "measures")
    return d.withColumns({name: ratio(a, b) for name, (a, b) in MEASURES.items()})


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure() with base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measure(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
