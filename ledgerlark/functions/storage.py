"""Intermediate tables in the folder that all executors share.

Lineage is cut with written Parquet tables (columnar and compressed, and they outlive a lost executor), in the folder
that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session, or a fresh local one where it is unset and the
    master is local (tests). On a cluster without the setting this raises, since a machine's own folder would be lost."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back; later uses don't compute it again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote, once nothing lazily reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        if path.getParent().toUri().getPath() == base.toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Frees shuffle files of finished queries. Spark drops them when the driver's JVM collects the plans that wrote them,
    which in a driver with little to collect can take long after a large stage. The bus that tells listeners of queries
    keeps the last one's plan until another one ends, so a tiny query goes first."""
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()
