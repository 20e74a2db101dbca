"""Arrow-batched row functions: the one way Python code is entered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from corpuscle.session import ship_package


def map_columns(df: DataFrame, columns: list[str], fn: Callable[..., dict[str, list]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to the named columns of each Arrow batch.

    Only ``columns`` cross to Python, in that order, each as a Python list; other columns of ``df``
    are pruned before the scan. ``fn`` returns one list per output column, all of one length, which
    may differ from the input's (a flat map). An empty batch yields an empty batch.
    """
    ship_package(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    names = kind.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(kind)
        for batch in batches:
            step = max(1, int(batch.num_rows * 16e6 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                got = fn(*(piece.column(i).to_pylist() for i in range(len(columns))))
                yield pa.RecordBatch.from_arrays([pa.array(got[n], type=out_schema.field(n).type) for n in names], schema=out_schema)

    return df.select(*columns).mapInArrow(run, kind)
