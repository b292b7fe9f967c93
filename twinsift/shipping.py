"""Sends the package to the Python workers of a session, once per application.

Workers that already have the package on their path (same image, --py-files) don't need
it; it makes a plain session on any cluster work.
"""

import os
import tempfile
import zipfile

_done = set()


def ship(spark):
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="twinsift-"), "twinsift.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("twinsift", os.path.relpath(p, here)))
    sc.addPyFile(target)
    _done.add(sc.applicationId)
    return spark
