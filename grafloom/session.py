"""Sessions for tests and benchmarks, and the folder shared by all executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, name: str = "grafloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and bench.py; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_OWN_DIRS: dict[str, str] = {}
#: Folders that scratch() opened, innermost last.
_OPEN: list[str] = []


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and the
    master is local (tests, a single machine), a temporary one, which is removed
    at the end; executors of a cluster could not read it."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN_DIRS:
            folder = tempfile.mkdtemp(prefix="grafloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _OWN_DIRS[application] = f"file://{folder}"
        path = _OWN_DIRS[application]
    return path.rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a context. Workers of a
    local master see what the driver sees; an installed package is on every
    machine. Where the driver runs says nothing about other machines."""
    package = Path(__file__).resolve().parent
    root, context = package.parent, spark.sparkContext
    if context.applicationId in _SHIPPED or "site-packages" in root.parts:
        return
    _SHIPPED.add(context.applicationId)
    if is_local(spark) and root in {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}:
        return
    folder = tempfile.mkdtemp(prefix="grafloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "grafloom_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))


def scratch_path(spark: SparkSession) -> str:
    """A new path for an intermediate result in the shared folder."""
    folder = _OPEN[-1] if _OPEN else f"{shared_dir(spark)}/grafloom-{spark.sparkContext.applicationId}"
    return f"{folder}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a
    lost executor costs no recomputation. The files stay until scratch() or
    clear_scratch() removes them."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is materialized inside goes to a folder of its own, which is removed
    at the end: for a query whose result has been written or fetched by then."""
    path = f"{shared_dir(spark)}/grafloom-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    _OPEN.append(path)
    try:
        yield path
    finally:
        _OPEN.remove(path)
        _remove(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that materialize() wrote in this application, once nothing
    reads it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"grafloom-{spark.sparkContext.applicationId}*")) or []:
        system.delete(status.getPath(), True)


def whole_groups(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """df with the rows of equal keys in one partition, sorted by order, for a
    pass over partitions that must see groups whole.

    Partitioning goes by a hash of the keys. By the keys themselves the planner
    may leave the exchange out where a join below has the same keys, and then
    adaptive execution may break that join's partitions up, since nothing
    declares that it needs them.
    """
    return df.withColumn("_whole", F.xxhash64(*keys)).repartition("_whole").sortWithinPartitions(*order).drop("_whole")


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, where the cluster's default file system gives it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def shared_files(path: str) -> tuple[object, str]:
    """(file system, path in it) of a qualified path in the shared folder, for a
    Python worker that reads files there itself."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
