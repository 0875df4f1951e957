"""Session helpers: table reading, the shared folder, whole-table counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts written by ``materialize`` and not released yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Read from ``spark.checkpoint.dir``. Where that is unset, a folder set in
    the context before is taken; else, and only if all runs on one machine
    (master ``local``), a temporary folder is made, which goes when Python
    ends. A cluster without such a folder is refused: each executor would
    write its part to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="inkwell-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage; the files survive the loss of any executor. Used where a
    costly intermediate result is read more than once. ``release`` removes
    what was written, once the results that read it have been taken.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"inkwell-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes all that ``materialize`` wrote since the last call, and tells how much; results not taken yet are lost."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
