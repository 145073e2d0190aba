"""Session helpers shared by every operator: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a temporary folder is made, set and removed
    at exit; on a cluster it must be set, since a folder of one machine is not shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="chunkwise-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


_MADE: list[str] = []


def _clear_local() -> None:
    for path in _MADE:
        if path.startswith(("/", "file:")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), True)


atexit.register(_clear_local)


def clear_tables(spark: SparkSession) -> int:
    """Remove the tables that :func:`persist_table` wrote for this application, once results that read them are done.

    On a local file system this happens at the end of the process by itself. Returns how many there were."""
    for path in _MADE:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_MADE)
    _MADE.clear()
    return n


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the writes inside go when each write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage (survives the loss of executors) and, unlike ``checkpoint()``, keeps column pruning for later reads.
    :func:`clear_tables` removes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package: Spark sends them a zip of it, once per application.

    Nothing is sent where PYTHONPATH already names the folder the package lies in.
    """
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = tempfile.mkdtemp(prefix="chunkwise-zip-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{made}/chunkwise-package", "zip", root, "chunkwise"))
    _SHIPPED.add(app)


def registered(query):
    """A registered query that can run whatever the workers' import path is."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
