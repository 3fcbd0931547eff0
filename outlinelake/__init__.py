"""Outline analytics on PySpark; see README.md."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

_applications: set[str] = set()


def ship(spark) -> None:
    """Give this package's modules to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _applications:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="outlinelake-"), "outlinelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    _applications.add(context.applicationId)


def shipped(query):
    """The query, with the package shipped first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
