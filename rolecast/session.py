"""Session helpers: checkpoint folder and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache, wraps
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import SparkSession

T = TypeVar("T")


def per_session(build: Callable[..., T]) -> Callable[..., T]:
    """Build columns once per Spark application and set of arguments.

    A column is an expression and belongs to no frame. Building the larger
    ones from Python takes longer than planning the query that uses them.
    """

    @lru_cache(maxsize=128)
    def cached(application: str, *args) -> T:
        return build(*args)

    @wraps(build)
    def call(*args) -> T:
        return cached(SparkContext.getOrCreate().applicationId, *args)

    return call


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, else a local one.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage so that
    a lost executor does not lose the data. A temporary folder is used only
    in local mode, where driver and executors share one disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rolecast-ckpt-"))
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors that do not have it installed.

    Functions run by Python workers name their module; on a cluster it must be importable
    there, by installation on every node or by this call, once per application.
    """
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="rolecast-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/rolecast", "zip", root, "rolecast"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder for a written table."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
