"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

_DONE: set[str] = set()


def attach(spark) -> None:
    """Ship the package to the executors once per application (``addPyFile``)."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quadfield-"), "quadfield.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join("quadfield", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)
