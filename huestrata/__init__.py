"""huestrata: a PySpark-native analytics engine for colour-centred data and training corpora."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile


_shipped: set[str] = set()


def reachable(spark) -> None:
    """Ships the package once per application, unless PYTHONPATH, which workers inherit, names its folder."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if home not in known and app not in _shipped:
        ship(spark)
        _shipped.add(app)


def ship(spark) -> None:
    """Sends the package to the executors of a session, for clusters on which it is not installed.

    Executors fetch the archive from the driver, so it lies in a folder of the driver's own
    until the driver ends.
    """
    folder = tempfile.mkdtemp(prefix="huestrata-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    source = os.path.join(folder, "src", "huestrata")
    shutil.copytree(os.path.dirname(os.path.abspath(__file__)), source, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "huestrata"), "zip", os.path.dirname(source), "huestrata"))
