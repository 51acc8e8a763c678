"""The driver's entry works without the corpus operators, whatever of theirs is missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASKED = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("missing", ["folders", "pipeline", "emptied", "module"])
def test_core_queries_stand_alone(tmp_path, missing):
    here = tmp_path / "repo"
    here.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", here)
    shutil.copytree(ROOT / "lattica", here / "lattica", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if missing == "folders" else [])))
    if missing in ("emptied", "module") and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", here)
    if missing == "emptied" and (here / "lattica/llm").exists():
        shutil.rmtree(here / "lattica/llm")
        (here / "lattica/llm").mkdir()
    if missing == "module":  # a library that only the operators need
        (here / "tiktoken.py").write_text("raise ImportError('broken')")
    out = subprocess.run([sys.executable, "-c", ASKED], cwd=here, env={"PYTHONPATH": str(here), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    n, corpus, known = out.stdout.split()
    assert int(n) > 100 and corpus == "False" and known == "True", out.stderr
