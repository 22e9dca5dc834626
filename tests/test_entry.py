"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.oracle_sql()))"


def copy(to: Path) -> Path:
    to.mkdir()
    shutil.copytree(ROOT / "episodica", to / "episodica", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    return to


def ask(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, keep_pipeline):
    from episodica.plans.oracle import SQL
    from episodica.plans.queries import QUERIES

    folder = copy(tmp_path / "repo")
    shutil.rmtree(folder / "episodica/llm", ignore_errors=True)
    if not keep_pipeline:
        (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    got = ask(folder)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split() == [str(len(QUERIES)), "0", str(len(SQL))]


@pytest.mark.skipif(not (ROOT / "episodica/llm").exists(), reason="the corpus operators are not there")
@pytest.mark.parametrize("broken", ["episodica/llm/queries.py", "episodica/llm/common.py", "corpus_pipeline.py"])
def test_what_is_there_must_import(tmp_path, broken):
    folder = copy(tmp_path / "repo")
    (folder / broken).write_text("import no_such_module_anywhere\n" + (folder / broken).read_text().replace("from __future__ import annotations\n", ""))
    got = ask(folder)
    assert got.returncode and "no_such_module_anywhere" in got.stderr
