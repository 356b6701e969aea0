"""Paths in the shared folder of the cluster.

The session names it in ``spark.checkpoint.dir``; every executor and the driver
can read it. Only where that setting is absent (tests on one machine) is a local
folder made, once for a session.

Results are lazy, so a table that a result still reads stays after the operator has
returned. Whoever has used its results up calls :func:`clear`, which deletes what the
session has written here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}
_given: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    folder, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder:
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="mnemolith-")
        folder = _local[app]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(app, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the tables that this session wrote below the shared folder, and count them; results that read them end."""
    context = spark.sparkContext
    gone = 0
    for path in _given.pop(context.applicationId, []):
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        gone += target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    return gone
