"""Every query of the subpackage on workers that cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import os, sys, importlib.util
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def bare(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("auditlake") is not None]}})

assert not spark.range(1).mapInArrow(bare, "found boolean").first()[0], "the workers have the package"
from auditlake.llm import queries
bad = []
for name, f in queries.QUERIES.items():
    try:
        f(spark, {sf!r}).write.format("noop").mode("overwrite").save()
    except Exception as e:
        bad.append(name + ": " + str(e)[-300:])
print("BAD", bad)
"""


def test_workers_without_the_package(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, tmp=str(tmp_path / "shared"), sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "BAD []" in said.stdout, said.stdout[-3000:] + said.stderr[-3000:]
