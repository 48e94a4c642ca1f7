"""What a session needs: the package in its Python workers, tables that survive their executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Functions then reach workers by name, so that a worker keeps module state
    (compiled patterns, caches) between tasks.  The archive goes through
    Spark's own file distribution; executors need no shared folder for it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan gives fewer partitions than there are.

    A small file is one task, however much work its rows are.  A large table keeps its scan as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else df.repartition(wanted)


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each evaluated once per row however often it is used above.

    Projections and filters above would otherwise be merged into the plan below, expression by
    expression.  The optimizer infers nothing from an outer generator and moves nothing through it.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode_outer(F.array(row)).alias("_once")).select(*df.columns, "_once.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors are one process, may fall back on a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "veilsift-checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is under it goes when this process ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/veilsift/{sc.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_drop, sc._jvm, sc._jsc.hadoopConfiguration(), root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _drop(jvm, configuration, root: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(configuration).delete(path, True)
    except (Py4JError, OSError):  # the JVM is gone: whoever keeps the shared folder clears it
        pass


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and survives the loss of executors: what is read later is a
    table in shared storage, not blocks on one machine.  It lasts as long as this process.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
