import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import draws as D
from weftline.functions import hashing as H
from weftline.functions.names import jaro_winkler, name_evidence, stem, stem_expr, tokens


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_known_hashes(spark):
    for text, want in (("", 2166136261), ("a", 3826002220), ("users", 1585235219), ("42_name_0_string", 4109419968)):
        assert one(spark, H.fnv1a(F.lit(text))) == want
    assert one(spark, H.fnv_uuid(F.lit("users_0_S_42"))) == "576e6d9d-546e-68e4-556e-6a77526e65be"
    assert one(spark, H.fnv_object_id(F.lit("users_0_S_42"))) == "576e6d9d546e68e4556e6a77"
    assert one(spark, H.fnv1a(F.lit(None).cast("string"))) is None


def test_uniform_is_uniform(spark):
    r = spark.range(20000).select(H.uniform(1, "t", "f", F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u")).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3] - 1 / math.sqrt(12)) < 0.01


def test_zipf_edges(spark):
    shares = D.zipf_shares(5, 1.0)
    for u, want in ((0.0, 1), (shares[0], 1), (shares[0] + 1e-9, 2), (shares[3] + 1e-9, 5), (1.0 - 1e-12, 5)):
        assert one(spark, D.zipf(F.lit(u), 5, 1.0)) == want
    assert one(spark, D.zipf(F.lit(0.7), 1)) == 1


def test_weighted(spark):
    p = {"low": 0.40, "medium": 0.35, "high": 0.17, "critical": 0.08}
    assert [one(spark, D.weighted(F.lit(u), p)) for u in (0.0, 0.41, 0.76, 0.93)] == list(p)


def test_names():
    assert jaro_winkler("user", "USER") == 1.0
    assert abs(jaro_winkler("user", "users") - (0.85 + 0.15 * 4 / 5)) < 1e-9
    assert abs(jaro_winkler("martha", "marhta") - 0.9611) < 1e-3
    assert jaro_winkler("a", "b") == 0.0
    assert tokens("orderNumber-id") == ["order", "number", "id"]
    assert stem("user_id") == "user" and stem("products") == "product"
    assert name_evidence("customer_id", "customers")["suffix"]


@settings(max_examples=25, deadline=None)
@given(st.text("abcdefkiys_", max_size=9))
def test_stem_as_expression(spark, name):
    assert one(spark, stem_expr(F.lit(name))) == stem(name)
