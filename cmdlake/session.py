"""Session defaults of the engine."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf and master, where given, come on top. One session serves a process."""
    builder = SparkSession.builder.appName("cmdlake")
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a session: they may start in another folder or on another machine."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not getattr(context, "_cmdlake_shipped", False) and (root / "cmdlake").is_dir():
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='cmdlake-')}/cmdlake", "zip", root, "cmdlake"))
        context._cmdlake_shipped = True
