"""Makes the package importable for Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, unless PYTHONPATH or the working
    folder has it already."""
    known = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if str(_ROOT) in known or app in _shipped:
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (_ROOT / "corpusloom").rglob("*.py"):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
