import pytest

from anisomap.plans import registry
from tests.comparing import assert_same, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_sql_gives(spark, sf, con, name):
    assert_same(registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_training_data_subpackage(spark, tmp_path):
    import json
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1 and set(entry.queries()) >= set(registry.QUERIES)
    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "anisomap", tmp_path / "anisomap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert json.loads(said.stdout) == [sorted(registry.QUERIES), sorted(registry.ORACLES)]
