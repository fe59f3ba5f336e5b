"""Sends this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> None:
    """Once per application: the package as an archive that Spark gives to all executors, also to later ones."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp())
    target = folder / f"rightsloom_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "rightsloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    _shipped[sc] = str(target)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
