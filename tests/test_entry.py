"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _before(copy: Path) -> dict[str, str]:
    """The environment with the copy ahead of what is on the path anyway."""
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(copy), *filter(None, [os.environ.get("PYTHONPATH")])])}


def test_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "doc_markdown" in entry.queries()


def test_without_the_optional_parts(tmp_path):
    """The package still imports, and registers its own queries, when the optional folders are gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_markdown' in q and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=_before(copy), timeout=120)


def test_tests_without_the_optional_parts(tmp_path):
    """All other tests can be collected, and those without Spark pass, when the optional folders are gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    run = lambda *more: subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", *more], cwd=copy, env=_before(copy), timeout=300, capture_output=True, text=True)
    found = run("--collect-only")
    assert found.returncode == 0, found.stdout + found.stderr
    done = run("-k", "settings or names_match or every_oracle or http_transport or attempts_count")
    assert done.returncode == 0, done.stdout + done.stderr


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "markdown"]
