"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a batch that a Python stage handles at a time; a longer row is handled alone.
SLICE_BYTES = 4 << 20
#: Spark's bound on the bytes of an Arrow batch, and what it is unless the session sets another.
BATCH_BYTES, SPARKS_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def mapped(df, run, schema):
    """df.mapInArrow(run, schema) with batches of about SLICE_BYTES.

    A batch of texts lies in the executor's off-heap memory up to twice while it
    grows, and once in the worker, for every task. The bound holds for the
    session from here on; one that the session has set itself is kept.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, SPARKS_BYTES) == SPARKS_BYTES:
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return df.mapInArrow(run, schema)


def _bytes(column: pa.Array) -> list[int]:
    if not pa.types.is_list(column.type):
        return pa.compute.binary_length(column).fill_null(0).to_pylist()
    size = [0] * len(column)
    for i, n in zip(pa.compute.list_parent_indices(column).to_pylist(), pa.compute.binary_length(column.flatten()).to_pylist(), strict=True):
        size[i] += n or 0
    return size


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of column, or its lists of texts, in one slice take about `most` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.num_rows == 1 or batch.column(column).nbytes <= most:
            yield batch
            continue
        size = _bytes(batch.column(column))
        start = total = 0
        for i, n in enumerate(size):
            if total + n > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401


def appended(docs, column: str, name: str, kind: str, arrow_kind: pa.DataType, values):
    """docs with one column more: values(list of the texts of column) for each slice of rows.

    `name` must not be a column of docs. All other columns pass through as they are.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column):
            got = pa.array(values(b.column(column).to_pylist()), arrow_kind)
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, name])

    return mapped(docs, run, schema)


def unused(columns: list[str], name: str) -> str:
    """name, or name with as many underscores as make it none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
