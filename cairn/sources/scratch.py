"""The folder that all executors share, and tables that are cut there.

Lineage is cut by writing a table and reading it back: later plans start from the files, whatever
executors are lost. The folder is the session's ``spark.checkpoint.dir``; one of this machine's is made
only where that is unset."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one made here only where that is unset (tests, one machine)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = getattr(spark.sparkContext, "_cairn_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="cairn-")
        _made.append(own)
        spark.sparkContext._cairn_shared = own
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new place under the shared folder, on whatever file system; removed when this Python process ends."""
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def local_path(uri: str) -> str:
    """The mounted path of a file: address. Formats that are mapped or appended need a mounted shared folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return uri
    raise ValueError(f"this operator needs a shared folder that is mounted on every machine, not {uri}")


def remove(path: str) -> None:
    """Deletes a scratch place: mounted ones directly, others through the cluster's file system."""
    if path.startswith(("file:", "/")):
        shutil.rmtree(local_path(path), ignore_errors=True)
    elif (jvm := SparkContext._jvm) is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        sc = SparkContext._active_spark_context
        conf = sc._jsc.hadoopConfiguration() if sc is not None else jvm.org.apache.hadoop.conf.Configuration()
        p.getFileSystem(conf).delete(p, True)
    if path in _made:
        _made.remove(path)


@atexit.register
def _clean() -> None:
    for path in list(_made):
        try:
            remove(path)
        except Exception as e:  # the file system may be gone by now; others are still to be cleaned
            print(f"not removed: {path} ({str(e)[:100]})", file=sys.stderr)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later plans start there, whatever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a cut table that nothing reads any more."""
    if (path := getattr(df, "_scratch", None)) is not None:
        remove(path)
