"""The entry module with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LEFT_OUT = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md")
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def counted(folder) -> list[str]:
    made = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return made.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_text_operators(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=LEFT_OUT)
    for folder in ("tidegauge/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    n, numbered, with_pipeline, known = counted(copy)
    assert int(n) >= 149 and (numbered, with_pipeline, known) == ("0", "False", "True")


def test_errors_inside_the_text_operators_are_not_hidden(tmp_path):
    if not (ROOT / "tidegauge/llm").exists():
        pytest.skip("text operators are left out")
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=LEFT_OUT)
    with (copy / "tidegauge/llm/common.py").open("a") as file:
        file.write("import no_such_module\n")
    with pytest.raises(subprocess.CalledProcessError):
        counted(copy)
