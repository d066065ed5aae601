"""Helpers that the operators share: input columns, words, tables kept between steps."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column can clash with a working name."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def words(text: Column) -> Column:
    """The words of a text; none for null, empty and blank texts."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a scratch folder of this machine only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpus-")


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder, and the table's path: lineage ends
    there, and a lost executor costs no more than the step at work."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder."""
    return stored_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of ``stored_at`` that nothing reads any more."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not one of the kept tables")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
