"""Every registered query of the catalogue against its SQL."""

import pytest

from weftline import queries as core

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(core.SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(core.QUERIES[name](spark, sf), con, core.SQL[name])


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(spark):
    """The entry module imports, and keeps its own queries, where the text operators are gone."""
    import subprocess
    import sys

    code = "import sys; sys.modules['weftline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_predicates_and_columns_reach_the_scan(spark, sf):
    plan = core.QUERIES["b_filter"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_mktsegment:string>" in plan


def test_generated_columns_stay_in_generated_code(spark):
    from .test_generate import social
    from weftline.operators.generate import Config, Generator

    plan = Generator(social(), Config({"users": 20, "posts": 100, "comments": 300})).frame(spark, "comments")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1] and "Join" not in plan
