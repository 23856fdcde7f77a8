"""Helpers that several text operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that a Python task turns over at once, however large an Arrow batch is.
ROWS_AT_ONCE = 512

# The folder that holds the library.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the library wherever the session was started; a cluster gets it by ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


def column(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one column, so that no name of theirs meets one of the work columns."""
    return F.struct(*[column(c).alias(c) for c in df.columns])


def beside(name: str, added: Sequence[str]) -> str:
    """The name under which a column comes back beside ``added`` ones: its own, or with ``_`` behind it if they take that."""
    while name.lower() in added:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The held-out third: crc32 of the id as text leaves 1 modulo 3; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from: those with an id outside the held-out third."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A function for ``mapInArrow`` that calls ``fn`` on slices of a few hundred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield fn(batch.slice(at, ROWS_AT_ONCE))

    return run


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows (one more than rows); a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
