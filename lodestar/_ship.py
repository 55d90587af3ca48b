"""Make the package importable on executors (``addPyFile`` of a zip)."""
from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship_package(spark) -> None:
    """Ship this package's code to the executors once per application.
    Skipped when ``LODESTAR_SHIP=0`` (package installed on the cluster or
    passed with ``--py-files``)."""
    if os.environ.get("LODESTAR_SHIP", "1") == "0":
        return
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lodestar-py-"), "lodestar.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.join("lodestar", os.path.relpath(p, root)))
    sc.addPyFile(out)
    _shipped.add(key)
