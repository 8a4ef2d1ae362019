"""What the training-data operators share: tables, words and materialised cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names; on a single machine a temporary one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or os.path.join(tempfile.gettempdir(), "lumenlake-shared")).rstrip("/")


_OPEN: list[list[DataFrame]] = []


@contextmanager
def cuts_removed() -> Iterator[None]:
    """Deletes, at its end, the tables that operators cut inside it. What reads them has to be written by then."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for df in made:
            drop_cut(df)


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for made in _OPEN:
        made.append(out)
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes the table behind a cut() that nothing lazy reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def by_place(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of df under plain names: an Arrow function's input can't have dots in its names."""
    return df.select(*(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)))


def without_white(text: Column) -> Column:
    """text less every white-space character, null as empty. replace() is a byte search, much faster than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
