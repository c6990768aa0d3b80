"""The entry module without the corpus subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    for pipeline in (False, True):
        if pipeline and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", copy)
        out = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=120)
        assert out.returncode == 0, out.stderr
        n, n_sql, corpus = out.stdout.split()
        assert int(n) >= int(n_sql) > 40 and corpus == "False"
