"""What a session needs before queries run: this package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HOME = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers through Spark's own file server, once per application.

    Nothing is done where the workers find it anyway: the folder that holds it is on PYTHONPATH or is the driver's
    working folder.
    """
    root = str(_HOME.parent)
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or os.path.realpath(os.getcwd()) == root:
        return
    mark = "papyra.shipped"
    if spark.sparkContext.getLocalProperty(mark) == spark.sparkContext.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="papyra-code-")) / "papyra_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(_HOME.rglob("*.py")):
            out.write(file, file.relative_to(_HOME.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext.setLocalProperty(mark, spark.sparkContext.applicationId)
