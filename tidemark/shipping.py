"""The package's code on executors: Python workers import it from an archive that the driver serves."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package's code once per application. Call it before a Python stage is declared."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def map_batches(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with the package's code at hand."""
    ship(df.sparkSession)
    return df.mapInPandas(f, schema)
