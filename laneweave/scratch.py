"""Folders that driver and executors share, for intermediate files."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import ConfigError

_local: dict[str, str] = {}


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; under a temporary folder where that is unset (one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            holder = tempfile.TemporaryDirectory(prefix="laneweave-")
            atexit.register(holder.cleanup)
            _local[app] = f"file://{holder.name}"
        base = _local[app]
    path = f"{base.rstrip('/')}/laneweave/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path
