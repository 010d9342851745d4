import pytest

from duskveil.llm.queries import ORACLES, QUERIES

from ..conftest import MEDIUM, SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, against_sql, name):
    against_sql(spark, name, QUERIES[name], ORACLES[name], MEDIUM)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_nothing_outside_imports_the_subpackage():
    import os
    import re

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "duskveil")):
        if "/llm" not in folder:
            for file in files:
                if file.endswith(".py"):
                    assert not re.search(r"(?:from|import)\s+\S*\bllm\b", open(os.path.join(folder, file)).read()), file
