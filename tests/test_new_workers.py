"""Arrow steps in Python workers that ran nothing before (a worker idle for a minute is ended)."""
import os
import subprocess
import sys

from conftest import ROOT

ENCODE = """
from sentiforge.session import get_session
from sentiforge.operators import lmprep
s = get_session("local[1]", 2, extra={"spark.python.worker.reuse": "false"})
lines = s.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "k long, toks array<string>")
vocab = lmprep.build_vocab(s.createDataFrame([("a",), ("b",)], "token string"), min_count=1)
print(sorted((r.k, r.ids) for r in lmprep.encode(lines, ["k"], "toks", vocab).collect()))
"""


def run(code):
    env = {**os.environ, "PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=200)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip().splitlines()[-1]


def test_encode_in_new_workers():
    assert run(ENCODE) == "[(1, [5, 6, 1]), (2, [])]"
