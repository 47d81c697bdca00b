"""Executors need the package where Python runs on them: it is sent once for each application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def send(spark: SparkSession) -> None:
    """Makes this package a Python file of every task of the session's application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="ripple-")) / "ripple_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        context.addPyFile(str(path))
        _sent.add(context.applicationId)


def ship(df: DataFrame) -> DataFrame:
    """``df``, once its application has this package."""
    send(df.sparkSession)
    return df
