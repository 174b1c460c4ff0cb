"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python kernel at once; bounds what a worker holds besides its input batch.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null: empty) and the named extra columns; other columns are left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def row_key() -> Column:
    """128 bits that only rows of one doc_id and one text (null: empty) share."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes (one row at least)."""
    for batch in batches:
        at, n = 0, batch.num_rows
        mean = max(1, batch.get_total_buffer_size() // max(1, n))
        step = int(max(1, min(rows, size // mean)))
        while at < n:
            yield batch.slice(at, step)
            at += step


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow over bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, rows):
            if (out := kernel(piece)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder that the session names, or on a local master, where none is set (as in tests), one of our own. A cluster must name one that all machines share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; the machines of a cluster need a folder that they share")
        context.setCheckpointDir(named or os.path.join(os.getcwd(), ".checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str, *parted: str) -> DataFrame:
    """df written as a table in the shared folder, in folders by the columns `parted`, and read again."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parted).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
