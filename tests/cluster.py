"""Queries on executors of their own, which have the package from nowhere but the driver."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import json, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1024m", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": {shared!r}, "spark.sql.warehouse.dir": {shared!r} + "/warehouse"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
print("FOUND", json.dumps({{n: queries[n](spark, {sf!r}).count() for n in {names!r}}}))
"""


def counts(names: list[str], sf: str, folder: Path, timeout: int = 400) -> dict[str, int]:
    """Rows of queries on two executors without the repository on their path or as their folder."""
    home = folder / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": str(folder / "local")}
    script = SCRIPT.format(repo=str(REPO), shared=str(folder / "shared"), sf=sf, names=names)
    run = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=timeout)
    assert run.returncode == 0, run.stderr[-3000:]
    return json.loads(run.stdout.rpartition("FOUND ")[2])
