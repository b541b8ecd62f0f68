"""The entry module without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_the_training_data_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".*"))
    for keep in (True, False):
        if not keep:
            (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr
        count, known, training = said.stdout.split()[-3:]
        assert int(count) >= 50 and known == "True" and training == "False"
