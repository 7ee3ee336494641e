import ast
import pathlib
import subprocess
import sys

import __spark_entry__ as entry_point

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["query_id", "id", "similarity", "fav_count", "final", "place"] and df.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_nothing_outside_imports_the_corpus_operators():
    for path in ROOT.glob("revmine/**/*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.unparse(node), path


def test_entry_without_the_corpus_operators(tmp_path):
    """A checkout without the corpus folders and the pipeline still imports and registers the rest."""
    for path in ROOT.rglob("*.py"):
        rest = path.relative_to(ROOT)
        if "llm" not in rest.parts and rest.name != "corpus_pipeline.py" and ".git" not in rest.parts:
            (tmp_path / rest).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rest).write_text(path.read_text())
    code = "import __spark_entry__ as e; names = set(e.queries()); assert 'knn_feedback' in names and not [n for n in names if n.startswith('op') or n == 'pipeline']; print(len(names))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout) > 50
