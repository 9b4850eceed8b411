"""The driver contract, also where the training-text operators or a library that only they need are absent."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWS = "import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if n[:2] != 'op']), len([n for n in q if n[:2] == 'op']), set(e.oracle_sql()) <= set(q))"


def shown(folder, before=""):
    done = subprocess.run([sys.executable, "-W", "always", "-c", before + SHOWS], cwd=folder, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    return done, done.stdout.strip().splitlines()[-1].split() if done.returncode == 0 else None


def test_a_missing_library_leaves_the_other_queries():
    done, (others, ops, sql) = shown(ROOT, "import sys; sys.modules['xxhash'] = None; ")
    assert int(others) >= 146 and (ops, sql) == ("0", "True")
    assert "without the training-text queries" in done.stderr


def test_deleted_folders_leave_the_other_queries(tmp_path):
    shutil.copytree(f"{ROOT}/lamella", tmp_path / "lamella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    done, (others, ops, sql) = shown(tmp_path)
    assert int(others) >= 146 and (ops, sql) == ("0", "True")
    assert "Warning" not in done.stderr


def test_an_error_inside_them_is_not_hidden(tmp_path):
    shutil.copytree(f"{ROOT}/lamella", tmp_path / "lamella", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from lamella.llm import no_such_name\n")
    done, _ = shown(tmp_path)
    assert done.returncode != 0 and "no_such_name" in done.stderr
