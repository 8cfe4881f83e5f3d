"""Running a small function over the rows of Arrow batches, with bounded memory on both sides."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

import quartzline

#: Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(quartzline)

#: Rows that are Python objects at a time, and the rows and bytes at which an output batch is handed on.
SLICE_ROWS, OUT_ROWS, OUT_BYTES = 64, 4096, 4 << 20
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<smallint>": pa.list_(pa.int16())}


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows; what Spark sends is bounded in bytes, its Python objects are by this."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def weight(values: tuple) -> int:
    return sum(v.nbytes if hasattr(v, "nbytes") else len(v) if isinstance(v, (bytes, str)) else 8 for v in values)


def map_rows(df: DataFrame, function: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """function takes a row's values and yields output rows as tuples; one pass, no shuffle. Rows are handed on as they come."""
    into = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)])

    def packed(rows):
        columns = list(zip(*rows, strict=True)) or [()] * len(into)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, into.types, strict=True)], schema=into)

    def run(batches):
        out, held = [], 0
        for batch in slices(batches):
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in function(*values):
                    out.append(row)
                    held += weight(row)
                    if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                        yield packed(out)
                        out, held = [], 0
        yield packed(out)

    return df.mapInArrow(run, schema)
