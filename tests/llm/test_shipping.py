"""Queries whose tasks use objects of this package's classes, run where executors cannot import it."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})  # the driver alone sees the package
import __spark_entry__ as entry
from workload.session import local_session
spark = local_session("2")
counts = {{name: entry.queries()[name](spark, "/root/testdata/sf0.001").count() for name in {names!r}}}
print("COUNTS", json.dumps(counts))
"""


def test_queries_run_without_the_package_on_executors(tmp_path):
    names = ["op3_decontaminate", "op5_brown", "op6_toxicity"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import json\n" + SCRIPT.format(repo=REPO, names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    line = next(x for x in done.stdout.splitlines() if x.startswith("COUNTS "))
    counts = json.loads(line[len("COUNTS "):])
    assert set(counts) == set(names) and counts["op5_brown"] > 0 and counts["op6_toxicity"] > 0
