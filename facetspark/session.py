"""Session helpers: defaults for local runs, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", name: str = "facetspark", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch between Spark and its Python workers, and Spark's own default.
ARROW_BYTES, _ARROW_DEFAULT = 4 << 20, 64 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that no node needs it installed.

    Arrow batches are bounded by bytes, as rows may be whole texts of any length; a bound
    that the session has set itself is left alone.
    """
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, f"{_ARROW_DEFAULT}b") == f"{_ARROW_DEFAULT}b":
        spark.conf.set(key, f"{ARROW_BYTES}b")
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="facetspark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("facetspark") / p.relative_to(root))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)
