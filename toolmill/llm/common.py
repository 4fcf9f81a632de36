"""Shared pieces: bounded Arrow slices, folds of documents, tables in the shared folder."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shards_for(rows: int, rows_per_shard: int) -> int:
    return max(1, math.ceil(rows / rows_per_shard))


def kept_with(shared, name: str, make: Callable[[dict], object]):
    """Something made from a broadcast dictionary, kept with it: a worker makes it once,
    not once a task. Functions travel by value, so module globals wouldn't last."""
    if name not in shared.value:
        shared.value[name] = make(shared.value)
    return shared.value[name]


def text_of(array: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with at most ``limit`` bytes of ``column`` (one
    row at least), so that working memory follows the longest text, not the batch."""
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def map_texts(
    docs: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object] | pa.RecordBatch | None], schema: str | T.StructType, limit: int = SLICE_BYTES
) -> DataFrame:
    """``fn`` over bounded slices of ``docs``; it returns columns by name (or a batch), or None for nothing."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        arrow = to_arrow_schema(target)
        for part in slices(batches, limit=limit):
            made = fn(part)
            if isinstance(made, pa.RecordBatch):
                yield made
            elif made is not None:
                yield pa.RecordBatch.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, target)
