"""Session set-up."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def builder(app: str = "noticeflow") -> SparkSession.Builder:
    """Settings that every job of this package wants; sizes are left to the cluster."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers that would not find it by themselves."""
    app = spark.sparkContext.applicationId
    named = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if app in _shipped or str(ROOT) in named:
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="noticeflow-")) / "noticeflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "noticeflow").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
