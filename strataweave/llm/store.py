"""Written tables that cut lineage, kept in the folder all executors share.

``spark.checkpoint.dir`` names that folder; only where a local session has none (tests, a laptop) is a temporary one made.
Parquet tables there survive a lost executor, and a join against one is dealt anew on both sides, so that adaptive
execution may split a hot key. A step drops the tables that nothing reads any more.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one, a temporary folder in local mode and an error on a cluster, whose
    executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="strataweave-"))
        found = "file://" + _own[0]
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back (with its schema, also when empty)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataweave/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`table` returned; nothing may read them any more."""
    for t in tables:
        out, path = _paths.pop(id(t), (None, None))
        if path:
            _written[:] = [w for w in _written if w[1] != path]
            _delete(out.sparkSession, path)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Ask the JVM to collect, so that the shuffle files of finished queries go from the disks now and not some time later."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_all() -> None:
    """Delete every table written by :func:`table` in this process."""
    _paths.clear()
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has gone, and its folder is the cluster's to clean
            return


atexit.register(drop_all)
