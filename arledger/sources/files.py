"""File listing. Listing reads names, sizes and times only, never file contents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return os.path.abspath("spark-warehouse/shared")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a step's files below the shared folder that nothing reads any more."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below ``root``: path, uri (escaped as in ``_metadata.file_path``),
    modificationTime, length. Empty files are not listed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        listed = reader.load(root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(root) from error
        raise
    return listed.select(
        "path", F.col("_metadata.file_path").alias("uri"), "modificationTime", "length"
    )


def latest_file(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """One row: the newest matching file; of equally new ones the last by name."""
    return (
        list_files(spark, root, glob)
        .select("path", "modificationTime")
        .orderBy(F.desc("modificationTime"), F.desc("path"))
        .limit(1)
    )


def latest_source_file(spark: SparkSession, root: str, glob: str | None = None) -> str:
    """Path of the newest matching file."""
    newest = latest_file(spark, root, glob).head()
    if newest is None:
        raise FileNotFoundError(f"no file matches {glob or '*'} in {root}")
    return newest["path"]
