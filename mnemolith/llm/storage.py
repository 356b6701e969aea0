"""Written tables in the shared folder of the cluster.

Iterative and multi-pass operators cut their lineage by writing Parquet there,
so a lost executor costs one task and not the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..scratch import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            context = table.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
