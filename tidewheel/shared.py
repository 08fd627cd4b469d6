"""The folder that the driver and every executor see."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``; a temporary one in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "root" not in _OWN:
            made = _OWN["root"] = tempfile.mkdtemp(prefix="tidewheel-shared-")
            atexit.register(shutil.rmtree, made, True)
        root = _OWN["root"]
    root = root.rstrip("/")
    return root if "://" in root or root.startswith("file:") else f"file://{root}"
