"""Every query of the library against its SQL, run by another engine."""

import pytest

from photolake.plans.registry import ORACLES, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, sf_dir, duck, name):
    result = QUERIES[name](spark, sf_dir).toPandas()
    same(result, duck.execute(ORACLES[name]).df())


def test_all_queries_are_listed_once():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 50


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    import pathlib
    import re

    import photolake

    top = pathlib.Path(photolake.__file__).parent
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert not re.search(r"photolake\.llm|from photolake import .*llm", p.read_text()), p


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["conf_gate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "embedding:" not in plan.split("ReadSchema")[-1]
