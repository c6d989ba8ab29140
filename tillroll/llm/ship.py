"""Make this package importable for the Python workers of a session.

A cluster job normally ships its package itself (``--py-files`` or an installed wheel). Where the
package's folder is not on the workers' path, its sources are sent along with the tasks.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tillroll-src-"), "tillroll"), "zip", root, "tillroll")
    sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)
