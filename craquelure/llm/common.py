"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a batch handed to Python holds at most so many rows and bytes, so long texts do not pile up in a worker
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def arrow_bounds(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def with_text(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the text, a missing text being empty."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def by_batch(
    df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict], *, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``fn`` turns a batch into named columns; the columns ``keep`` go through unchanged.

    ``schema`` describes the columns that ``fn`` makes; those of ``keep`` come before them.
    """
    arrow_bounds(df.sparkSession)
    kept = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in keep)
    full = ", ".join(x for x in (kept, schema) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = {n: batch.column(n) for n in keep} | fn(batch)
                yield pa.RecordBatch.from_pydict(made)

    return df.mapInArrow(run, full)


def lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a list column out of flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder that ``spark.checkpoint.dir`` names."""
    from craquelure.session import checkpointed as cut

    return cut(df)


def words_of(text: Column) -> Column:
    """Words of a text: runs without blank, tab, line feed, vertical tab, form feed and return."""
    blanks = "\t\n\x0b\x0c\r"
    plain = F.trim(F.translate(text, blanks, " " * len(blanks)))
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def row_key(*columns: str) -> Column:
    """A digest that tells rows apart by the given columns; missing values count as values."""
    return F.md5(F.to_json(F.struct(*columns)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one that ``spark.checkpoint.dir`` names."""
    import uuid

    from craquelure.session import checkpoint_folder

    root = checkpoint_folder(spark)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has ``most`` rows or fewer, and whether it has.

    The caller chooses ``most`` by the width of a row; beyond it the join is left to a shuffle.
    """
    small = df.count() <= most
    return (F.broadcast(df), True) if small else (df, False)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with an underscore before them, and as many more as it takes to differ from ``columns``."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found
