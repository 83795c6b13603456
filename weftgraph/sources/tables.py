"""Reading the tables, and cutting long plans at a written table in the shared folder."""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a folder of this machine, but only if no other machine takes part."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='weftgraph-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and its folder is then its owner's
        pass


def materialize(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends there, a lost executor loses nothing.

    Columnar and compressed, so later steps read only the columns they use. The files go when `release` is called, or
    when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Removes the files of a written table no later step reads. Other frames are left alone."""
    if path := getattr(df, "_written", None):
        _remove(df.sparkSession, path)


def fingerprint(df: DataFrame) -> str:
    """What the files below a frame are: their paths, lengths and times. Another write gives another fingerprint."""
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    seen = []
    for name in sorted(df.inputFiles()):
        p = path(name)
        status = p.getFileSystem(conf).getFileStatus(p)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:24]


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder under a name, once: where it stands there already it is read, by whatever session.

    The name must hold a `fingerprint` of what `df` is made of. A table appears by one rename, so none is read half.
    """
    spark = df.sparkSession
    target = f"{shared_dir(spark)}/kept-{name}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(target)):
        staged = f"{target}.{uuid.uuid4().hex}"
        df.write.parquet(staged)
        if fs.exists(path(target)) or not fs.rename(path(staged), path(target)):
            _remove(spark, staged)  # another session was first
    return spark.read.schema(df.schema).parquet(target)
