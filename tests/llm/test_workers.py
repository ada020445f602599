import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from watchloom.session import build_session
from watchloom.llm import ecoc, licenses, packing, quality, simhash
spark = build_session("elsewhere", 2, 2)
docs = spark.createDataFrame([(1, "Released under the MIT License. " * 20, "en"), (2, "zwei drei vier", "de")], "doc_id long, text string, lang string")
assert quality.ledger(docs).count() == 2
assert len(simhash.near_duplicates(docs).collect()) == 2
assert licenses.scan(docs).count() == 1
assert packing.pack(docs, lambda: lambda t: [1, 2]).count() >= 1
assert docs.select(ecoc.predict(ecoc.fit(docs), docs)).count() == 2
print("fine")
"""


def test_workers_need_no_copy_of_the_library(tmp_path):
    """Started from another folder, with the library on the driver's path only."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    # Folders of other packages stay: only this repository's own entries go.
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.realpath(p).startswith(os.path.realpath(repo))]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-1500:]
