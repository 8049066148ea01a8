"""Makes this package known to Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import tessella

_shipped: set[str] = set()


def ready() -> None:
    """Sends the package to the executors of the active session, once, unless PYTHONPATH gives it to them."""
    from pyspark.sql import SparkSession

    root = Path(tessella.__file__).resolve().parent.parent
    spark = SparkSession.getActiveSession()
    if spark is None or str(root) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="tessella-")  # the driver serves it from here until it ends
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder, "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "tessella").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
