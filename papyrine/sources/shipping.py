"""Makes the package importable by the Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context.

    The archive is a file of the driver, which serves it to the executors itself; where the
    intermediates lie doesn't matter.
    """
    sc = spark.sparkContext
    if getattr(sc, "_papyrine_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    # Tasks fetch the file when they start, so it stays as long as the driver's process.
    folder = tempfile.mkdtemp(prefix="papyrine-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "papyrine.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(target)
    sc._papyrine_shipped = True
