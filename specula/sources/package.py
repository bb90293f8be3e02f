"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

#: Spark's setting for the largest generated method that it runs as one, and HotSpot's limit: a larger one is never compiled
#: to machine code. Beyond the limit Spark runs the steps one by one, each in methods small enough.
METHOD, COMPILED = "spark.sql.codegen.hugeMethodLimit", 8000


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application, and keep generated methods within :data:`COMPILED`."""
    if int(spark.conf.get(METHOD, "65535")) > COMPILED:
        spark.conf.set(METHOD, str(COMPILED))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        to = os.path.join(tempfile.mkdtemp(prefix="specula-"), "specula.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(to)
        _SHIPPED.add(sc.applicationId)
    return spark
