"""The driver's entry can be read without a session, and with the training-data operators gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
READ = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() for n in q))"


def read(folder):
    return subprocess.run([sys.executable, "-c", READ], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})


def test_entry_without_a_session():
    out = read(ROOT)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[0]) > 120


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "shelfwise", tmp_path / "shelfwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = read(tmp_path)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split()[1] == "0"
