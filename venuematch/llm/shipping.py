"""Making this package importable in Python workers, and keeping their batches small."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()


def workers_ready(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application, and bound Arrow batches by bytes.

    A batch otherwise holds 10 000 rows, however long their texts are; a bound that the caller has set stays.
    """
    if int(spark.conf.get(BATCH_BYTES, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(BATCH_BYTES, str(16 << 20))
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="venuematch-src-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    _sent.add(sc.applicationId)
