"""The library runs without the document operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_starts_without_the_document_operators(tmp_path):
    shutil.copytree(f"{REPO}/watchloom", tmp_path / "watchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    # With or without the root pipeline file, which can't work without those operators.
    for _ in range(2):
        script = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'group_incidents' in q and set(o) <= set(q) and not any(n.startswith('op1') or n == 'pipeline' for n in q); print('fine')"
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != REPO)}
        out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert "fine" in out.stdout, out.stderr[-1500:]
        if os.path.exists(f"{REPO}/corpus_pipeline.py"):
            shutil.copy(f"{REPO}/corpus_pipeline.py", tmp_path)
