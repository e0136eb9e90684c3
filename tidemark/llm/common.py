"""What the corpus operators share: table access, word patterns, hashing and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.views import shared_folder

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's reader opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order, as an array (null text: empty array)."""
    plain = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:  # one literal separator splits faster than a pattern
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of each query when that query ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it outlives executors and is computed once."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; a plan that still did would fail, not miss rows."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
