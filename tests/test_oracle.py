"""Every registered query with SQL matches DuckDB on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from scripts.check_oracle import frame_hash

from .conftest import SF_SMALL

SQL = entry.oracle_sql()


_DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    """Same rows, same columns, same column types."""
    df = entry.queries()[name](spark, SF_SMALL)
    rel = duck.sql(SQL[name])
    types = {f.name: _DUCK_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert frame_hash(df.toPandas()) == frame_hash(duck.execute(SQL[name]).fetchdf())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_lets_only_the_absence_of_llm_pass(tmp_path):
    """Without the llm files the other queries are there; an error inside them is raised."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"

    def run():
        return subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True,
                              env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(root, "delayrisk"), tmp_path / "delayrisk",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = run()
    assert out.returncode == 0 and "False" in out.stdout, out.stderr
    (tmp_path / "delayrisk" / "llm").mkdir()
    (tmp_path / "delayrisk" / "llm" / "__init__.py").write_text("import no_such_module_xyz\n")
    (tmp_path / "corpus_pipeline.py").write_text("import delayrisk.llm\n")
    assert "no_such_module_xyz" in run().stderr


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["masterbill_internal_id", "volume_cm3", "distance_km", "total_weight",
                          "hazardous_material_flag", "margin_value"]
    assert df.count() > 0
