import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == __spark_entry__.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_the_training_data_part(tmp_path):
    """A copy without those folders still imports and lists its queries."""
    import shutil

    shutil.copytree(ROOT / "orderlens", tmp_path / "orderlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    # Compiled files that were left behind are no package.
    (tmp_path / "orderlens/llm/__pycache__").mkdir(parents=True)
    (tmp_path / "orderlens/llm/__pycache__/queries.cpython-313.pyc").write_bytes(b"")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    # A fault inside the part isn't taken for its absence.
    (tmp_path / "orderlens/llm/__init__.py").write_text("")
    (tmp_path / "orderlens/llm/queries.py").write_text("import no_such_module_here")
    (tmp_path / "corpus_pipeline.py").write_text("")
    broken = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert broken.returncode and "no_such_module_here" in broken.stderr
