"""Shared helpers: table access, materialisation in the shared folder, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.storage import materialize

__all__ = ["crc_fold", "map_text", "materialize", "release", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that is free back to the system at the end of a partition: workers stay for the stages after."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text stays near most_bytes (one row at least)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(df: DataFrame, fn: Callable[[list[str], pa.RecordBatch], dict], schema: T.StructType, text: str = "text", most_bytes: int = 4 << 20) -> DataFrame:
    """Apply fn to slices of rows: (texts with null as '', the slice) -> columns of the output schema."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, text, most_bytes):
                texts = [x or "" for x in part.column(text).to_pylist()]
                out = fn(texts, part)
                cols = [out[n] if isinstance(out[n], (pa.Array, pa.ChunkedArray)) else pa.array(out[n], type=target.field(n).type) for n in names]
                cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
                yield pa.RecordBatch.from_arrays([c.cast(target.field(n).type) for c, n in zip(cols, names, strict=True)], schema=target)
        release()

    return df.mapInArrow(run, schema)


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo folds (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)
