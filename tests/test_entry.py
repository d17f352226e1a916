"""The registered queries and their SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as e
from varilake import session


def test_names_and_entry(spark, data):
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 4)} <= set(q)
    assert e.entry(spark).columns == ["tab", "col", "load_id", "measure"]


def test_core_does_not_import_llm():
    code = "import sys; import varilake.queries.genotypes, varilake.queries.quality; assert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(e.__file__).rsplit("/", 1)[0])


def _run(code, where):
    return subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=where)


def test_a_missing_dependency_is_an_error(tmp_path):
    """The subpackage may be absent; a module that it needs may not."""
    root = str(e.__file__).rsplit("/", 1)[0]
    if "p5_found" not in e.queries():
        return
    blocked = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__"
    assert "ahocorasick" in _run(blocked, root).stderr
    absent = "import sys; sys.modules['varilake.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p5_found' not in e.queries()"
    assert _run(absent, root).returncode == 0


def test_no_machine_local_tables_on_a_cluster():
    class Fake:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        session.shared_folder(Fake)


def test_tables_are_deleted(spark):
    table = session.materialize(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path) and table.count() == 3
    session.release(spark)
    assert not os.path.exists(path)
