"""Session-level services: shared scratch tables and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, os.path.join(_PACKAGE.name, p.relative_to(_PACKAGE)))
    sc.addPyFile(str(target))
    sc._plumbline_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset (tests).

    On a cluster, a temporary folder would be each machine's own, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not (sc.master or "").startswith("local") or "cluster" in (sc.master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_plumbline_scratch", None):
        sc._plumbline_scratch = "file://" + tempfile.mkdtemp(prefix="plumbline-scratch-")
    return sc._plumbline_scratch


#: Bytes of files below which a table that comes in few files is dealt out over all cores.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in a few files, whose scan would be one task for each row group, dealt over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage like ``checkpoint()`` but columnar and compressed; any
    executor can read the files, so a lost executor costs no recomputation.
    Files go when the driver's JVM exits, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    fs, hpath = _on_fs(spark, path)
    fs.deleteOnExit(hpath)
    out = spark.read.schema(schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` gave, once nothing that is still to run reads it."""
    path = getattr(df, "_plumbline_path", None)
    if path:
        fs, hpath = _on_fs(df.sparkSession, path)
        fs.delete(hpath, True)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a small file to any store that Spark writes to."""
    fs, hpath = _on_fs(spark, path)
    stream = fs.create(hpath, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    fs.deleteOnExit(hpath)
    return path


def _on_fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(sc._jsc.hadoopConfiguration()), hpath


def sample_by_hash(df: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``columns``; the same rows at any partitioning.

    A bound on the hash, from a count, is applied first. Else each partition would send
    ``n`` rows of its own to the driver.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns])
    total = df.count()
    if total > 2 * n:
        df = df.where(h <= int(2.0**64 * 2 * n / total) - 2**63)
    return df.orderBy(h, *[F.col(f"`{c}`") for c in columns]).limit(n)
