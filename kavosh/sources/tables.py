"""Parquet tables of one data directory, and where intermediate results may be kept."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir`` (a file or a folder of Parquet files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    A temporary folder stands in only where one machine does all the work; on a cluster a missing
    setting is an error, since each executor would write to a disk of its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = jdir.get() if jdir.isDefined() else None
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="kavosh-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back.

    Cuts the lineage: losing an executor costs a re-read, never a recomputation. One Parquet
    table per call, compressed, under a name of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fanout(spark: SparkSession, per_core: int = 1) -> int:
    """Number of tasks for a stage that works hard on few bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * per_core)


#: A core's share of input (the bytes Spark puts in one split) beyond which a scan has work for every core.
SPLIT_BYTES = 128 << 20


def scan_bytes(df: DataFrame) -> int:
    """How many bytes the tables under ``df`` have, as their scans say; 0 where they can't say. Nothing runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return size if size < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many splits as there are cores, for stages that work hard on few bytes.

    A small table of a few files is read by a few tasks; only such tables are dealt out again. Sizes and
    file counts are those of the scan, so nothing runs here; a stream is left alone.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan_bytes(df) < cores * SPLIT_BYTES and 0 < len(df.inputFiles()) < cores else df


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file in a shared folder: written aside and then put in its place, so it is there whole or not at all."""
    fs, p = _file_system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    fs.rename(aside, p)


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of such a file; None where there is none."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder with what is in it."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
