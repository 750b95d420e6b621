"""All queries in a session whose workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def look(batches):
    for b in batches:
        try:
            import lakeloom
            yield b
        except ModuleNotFoundError:
            pass

assert spark.range(4).mapInArrow(look, "id long").count() == 0, "workers can import the package"
sys.path.insert(0, sys.argv[1])
import __spark_entry__

for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name in ("pipeline", "token_set_ratio", "search_all", "sanitize_filename", "survivor_order_tolerant"):
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_workers_need_no_copy_of_the_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",)}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO), sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran op") == 10 and "ran pipeline" in done.stdout
