"""Sends this package to the executors, whose Python workers import its functions by name."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> Path:
    """A new folder for files that Spark's file server hands out: in the shared checkpoint folder, if the driver may write there."""
    shared = re.sub("^file:(//)?", "", spark.conf.get("spark.checkpoint.dir", None) or "")
    if shared.startswith("/"):
        try:
            Path(shared).mkdir(parents=True, exist_ok=True)
            return Path(tempfile.mkdtemp(prefix="wordtide-", dir=shared))
        except OSError:
            pass  # the driver may not write there
    return Path(tempfile.mkdtemp(prefix="wordtide-"))


def ship(spark: SparkSession) -> None:
    """Once per Spark context: Spark's own file server hands the zipped package to every executor that joins.

    The zip lies in the shared checkpoint folder if that is a plain folder; otherwise only the driver, which serves it,
    needs to see it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_wordtide_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = shared_folder(spark) / "wordtide.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))
    sc._wordtide_sent = True
