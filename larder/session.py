"""A session with the settings every plan here assumes: ANSI, UTC and adaptive execution."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors share; a local one only where all tasks run in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="larder-"))
        shared = f"file://{_local[0]}"
    return f"{shared.rstrip('/')}/larder/{name}-{uuid.uuid4().hex}"


def get_session(app: str = "larder", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one; ``conf`` has dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
