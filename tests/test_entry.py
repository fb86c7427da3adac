import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=False)


def test_imports_without_the_training_data_parts(tmp_path):
    shutil.copytree(ROOT / "noticeflow", tmp_path / "noticeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') for n in q))")
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 40 and out.stdout.split()[2] == "False"


def test_a_broken_import_is_not_swallowed(tmp_path):
    shutil.copytree(ROOT / "noticeflow", tmp_path / "noticeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in run(tmp_path, "import __spark_entry__ as e; e.queries()").stderr


def test_sql_names_are_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
