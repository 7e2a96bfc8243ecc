import __spark_entry__ as entry
from featurescape.plans import registry


def test_entry_flagship_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 200
    assert set(df.columns) >= {"ID", "passive", "x", "y", "clustered", "representative", "visible"}
    # every cluster shows exactly its representatives; unclustered items stay visible
    assert all(r["visible"] == (not r["clustered"] or r["representative"]) for r in rows)


def test_every_query_has_sql_or_is_rows_only():
    rows_only = set(registry.QUERIES) - set(registry.ORACLE_SQL)
    assert rows_only == {"neighbor_embedding", "tsne_embedding"}
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_training_data_modules(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(entry.__file__).parent
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "featurescape", tmp_path / "featurescape", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[-2:] == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))]
