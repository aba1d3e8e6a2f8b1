"""Written tables that cut lineage and serve several readers.

A staged table lives in the folder the cluster names in ``spark.checkpoint.dir``, which
driver and executors share, so a lost executor costs nothing but the running task. Tables lie in a
folder of the application, which goes when the driver's Python ends or ``clear`` is called; those
of one piece of work go earlier in ``with run(spark): ...``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_RUNS: list[str] = []
_KNOWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (local tests) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-staged-")
    return _LOCAL[app]


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Spark's own file systems, whatever the scheme."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        atexit.register(_at_end, spark, path)
    return path


def _at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError, AttributeError):  # the JVM or the context may have gone first
        _delete(spark, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{_RUNS[-1] if _RUNS else _folder(spark)}/{uuid.uuid4().hex}/{label}"


@contextlib.contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """What is staged inside is removed at the end; write results elsewhere before."""
    _RUNS.append(f"{_folder(spark)}/run-{uuid.uuid4().hex}")
    try:
        yield _RUNS[-1]
    finally:
        _delete(spark, _RUNS.pop())


def clear(spark: SparkSession) -> None:
    """Removes all that this application has staged; tables that were read from there are gone."""
    _delete(spark, _folder(spark))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
