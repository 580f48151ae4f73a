"""Small helpers around the Spark session: tables, the shared folder, materialising."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; Parquet, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a temporary folder does if everything runs on this
    machine; on a cluster executors could not read each other's files there, so
    it is an error.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="guardloom-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage without keeping blocks on executors, so losing one of
    them costs nothing; columns can be pruned on each later read. What was
    written is deleted by ``forget`` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/part-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget() -> None:
    """Delete what ``materialize`` wrote; frames that read it must not be used any more."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session is gone, and with it the way to the folder
            return


def spread(df: DataFrame) -> DataFrame:
    """Give work on texts enough partitions: a table in one small file would be one task.

    Meant for what is read or built without a shuffle; a table of many files is left as it is.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want // 2 else df


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes (files' size for plain scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
