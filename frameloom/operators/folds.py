"""Ordered folds: sequential semantics over one key's rows in order, without gathering them.

Rows are partitioned by the key and sorted within partitions; each task streams through its keys and holds one
key's state at a time. Batch queries and stateful streams call the same step functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def fold_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], Any],
    step: Callable[[Any, dict], list[tuple]],
    ddl: str,
    finish: Callable[[Any], list[tuple]] | None = None,
) -> DataFrame:
    """Rows that ``step(state, row)`` returns for each row, and ``finish(state)`` after a key's last row."""
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, out = None, None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    if at is not None and finish:
                        out += finish(state)
                    state, at = start(), key
                out += step(state, row)
            if out:
                yield emit()
                out = []
        if at is not None and finish:
            out += finish(state)
        if out:
            yield emit()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)
