"""Promotion catalog analytics as Spark jobs."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Make this package importable in Python workers that do not share the driver's path."""
    context = spark.sparkContext
    if getattr(context, "_offerloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "offerloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("offerloom", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._offerloom_shipped = True


def shared_dir(spark) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a folder of this machine, which only a local master can use."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def prepared(query):
    """A query that can run on a session as it comes: the package shipped, a checkpoint folder set."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return query(spark, sf_dir)

    return run
