"""Worker-side Python (scorer plug-in, deep JSON walk) must not need this repo on the
executors' path: run both from a process whose working folder is elsewhere."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for n in ["plugin_scorer_replies", "customer_json_deep_labels"]:
    print(n, E.queries()[n](spark, "/root/testdata/sf0.001").count())
"""


def test_python_workers_need_no_repo_on_path(tmpdir_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmpdir_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    counts = dict(line.split() for line in out.stdout.strip().splitlines())
    assert int(counts["plugin_scorer_replies"]) > 0 and int(counts["customer_json_deep_labels"]) > 0
