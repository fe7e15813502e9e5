import json
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_without_training_data_operators(tmp_path):
    """The rest stands without the llm folders and the pipeline."""
    shutil.copytree(ROOT / "poslex", tmp_path / "poslex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e, poslex.collection; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True, check=True)
    queries, sql = json.loads(out.stdout)
    assert "attr_frq" in queries and set(sql) <= set(queries)
    assert not [q for q in queries if q.startswith("op") or q == "pipeline"]


def test_nothing_else_imports_them():
    for path in (ROOT / "poslex").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
