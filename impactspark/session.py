"""Session helpers: a session with the settings the engine wants, and the package on every worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def get_spark(app: str = "impactspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and a UTC clock; settings given by the cluster or by the caller win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run on executors refer to the package by name; workers that were not started with it on
    their path get it as a zip file.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="impactspark-pkg-"), "impactspark_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, as in tests, a folder of our own will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="impactspark-"))
        base = _OWN[0]
    return base.rstrip("/")


def shared_file(spark: SparkSession, name: str) -> str:
    """A path in scratch_dir() for what opens files by path, as SQLite does; the folder must be mounted everywhere."""
    base = scratch_dir(spark)
    if base.startswith("file:"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    if not base.startswith("/"):
        raise ValueError(f"{base} is no mounted folder; a single-file index needs one")
    os.makedirs(base, exist_ok=True)
    return os.path.join(base, name)
