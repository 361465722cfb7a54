"""Intermediate tables in the folder the cluster shares, so that a lost executor costs no results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder: `spark.checkpoint.dir` of the session. Where that is unset, a temporary one, but only if all
    runs on this machine; on a cluster others could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridsense-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit, and then nothing can be deleted
            return


def plain_unions(spark: SparkSession) -> None:
    """Keep the planner from carrying partitionings through unions: in Spark 4.1 it fails where the adaptive planner has
    given the parts of a union different numbers of partitions. Results do not depend on it."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def together(*makers: Callable[[], object]) -> list:
    """What these return, which don't need each other and so are run at once."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return list(pool.map(lambda f: f(), makers))


def once(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table; as it is if it is one."""
    return df if getattr(df, "_scratch_path", None) else table(df, name)


def drop(df: DataFrame) -> None:
    """Delete a table made by `table` once nothing lazy reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def tables() -> set[str]:
    """The tables that `table` has made and nobody dropped."""
    return {path for _, path in _made}


def sweep(spark: SparkSession, before: set[str], keep: DataFrame) -> None:
    """Delete the tables made since `before`, once nothing lazy reads them any more; `keep` stays."""
    for path in tables() - before - {getattr(keep, "_scratch_path", None)}:
        _delete(spark, path)
    _made[:] = [x for x in _made if x[1] in before or x[1] == getattr(keep, "_scratch_path", None)]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batch to `rows` and 16 MB, so that batches of long texts stay small in executors and
    workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
