"""Temporal stream analytics on Spark, and operators for training data."""

from __future__ import annotations

import os
import tempfile


def find_package(spark) -> None:
    """Let Python workers look for this package where the driver has it; a cluster may bring it by ``--py-files`` instead."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, paths) if x)


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, Spark must run in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "tideline-checkpoints")
    return folder
