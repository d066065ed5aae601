"""Session settings the library is meant to run with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Coalesces small shuffle partitions, splits skewed ones, picks joins by real sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. Stages that would
    # generate one run with smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


#: Removes the shuffle files of a query when it ends. Otherwise they stay until the driver happens to
#: collect its garbage, and those of several steps fill the disks at once. Tasks with rows of few
#: sheets write them side by side, without a sort that may spill.
_LEAN = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """Frames made inside leave no shuffle files behind once they are written. For frames that are
    written once: to run one again is right, but makes its shuffles anew."""
    before = {name: spark.conf.get(name, None) for name in _LEAN}
    for name, value in _LEAN.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
