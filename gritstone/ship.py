"""The package for executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Give all executors, now and later, this package as a zip file, which the driver serves; the file's path.

    Not needed where the package is installed on every machine, or the master is a local one that shares the driver's path."""
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gritstone-ship-")) / "gritstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*")):
            if f.is_file() and f.suffix != ".pyc":
                z.write(f, Path(home.name) / f.relative_to(home))
    spark.sparkContext.addPyFile(str(target))
    return str(target)
