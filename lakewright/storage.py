"""Tables, shared scratch space and lineage cuts.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir``, which every
executor and the driver can reach, in a folder of the application that goes when the application ends.
Only where the setting is unset and the master is local (tests, a laptop) does a temporary folder of
this process take its place; on a cluster a missing setting is an error, as tables in machine-local
folders would read as empty elsewhere.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_scope: ContextVar[str] = ContextVar("scope", default="default")
_written: dict[str, list[str]] = {}
_homes: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by any path that Spark's readers accept."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared scratch folder's URI: ``spark.checkpoint.dir``, or on a local master a folder of this process."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: scratch tables need a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lakewright-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _home(spark: SparkSession) -> str:
    """The application's own folder, deleted when its JVM ends."""
    home = f"{shared_root(spark)}/lakewright/{spark.sparkContext.applicationId}"
    if home not in _homes:
        store, p = _filesystem(spark, home)
        store.mkdirs(p)
        store.deleteOnExit(p)
        _homes.add(home)
    return home


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, remembered under the current scope."""
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(_scope.get(), []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a shared table and return a frame that reads it: lineage ends here.

    The table is compressed and columnar, outlives lost executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope():
    """Scratch paths made inside belong to the scope, whose name ``release`` takes."""
    name = uuid.uuid4().hex
    token = _scope.set(name)
    try:
        yield name
    finally:
        _scope.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope; frames that still read them can't be used any more."""
    for path in _written.pop(name, []):
        store, p = _filesystem(spark, path)
        store.delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
