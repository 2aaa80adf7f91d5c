"""Helpers shared by the corpus operators: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One of the corpus tables, with only the columns asked for (all of them by default)."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table if columns is None else table.select(*columns)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster this raises, as executors
    could not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="barlens-scratch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back.

    This cuts the lineage, survives lost executors, and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/barlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on the session's Arrow batches have at most so many rows (a lower setting stays).

    Texts are many times larger than the rows that Spark's default is made for, and each task holds a batch on either side.
    The setting must hold when the result is computed, after the operator has returned its plan, so it is not taken back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within: at most so many rows in an Arrow batch, for texts that Python turns into much larger objects."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``; later reads of it fail."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_text(column: str = "doc_id") -> Column:
    """The id as text; null becomes the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_text(column: str = "text") -> Column:
    """The text; null becomes the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
