"""Tables written to the folder that driver and executors share, so that lost executors cost no recomputation."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_OPEN: list[list[tuple[SparkSession, str]]] = []


def scratch(spark: SparkSession, name: str = "cut") -> str:
    """A path for a fresh folder in the one that the session names; on a single machine without that setting a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    path = f"{(root or os.path.join(tempfile.gettempdir(), 'lumenlake-shared')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def cuts_removed() -> Iterator[None]:
    """Deletes, at its end, the folders that operators wrote inside it. What reads them has to be written by then."""
    made: list[tuple[SparkSession, str]] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for spark, path in made:
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
