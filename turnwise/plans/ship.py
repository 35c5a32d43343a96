"""Making the package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's own modules to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_turnwise_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # not when the package itself runs from an archive
        archive = Path(tempfile.mkdtemp(prefix="turnwise-")) / "turnwise.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
    sc._turnwise_shipped = True
