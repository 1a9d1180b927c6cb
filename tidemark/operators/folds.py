"""Order-dependent folds: sorted rows streamed past one state a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(
    rows: DataFrame, by: list[str], order: list[str], reads: list[str], adds: str, start: Callable[[], Any],
    step: Callable[..., tuple[Any, tuple]],
) -> DataFrame:
    """``rows`` with the columns ``adds`` (a schema string), which ``step`` makes row by row.

    Rows are dealt out by ``by`` and sorted by ``order`` within; each group begins with
    ``start()`` and every row gives ``step(state, *values of reads) -> (state, values of adds)``.
    Only the current group's state is held, whatever its length, and time is linear in it. Values are Python's own,
    so 64-bit integers and nulls stay what they are. A group is one history and by its nature one task.
    """
    made = StructType.fromDDL(adds)
    kinds = [to_arrow_type(f.dataType) for f in made]
    names = [*rows.columns, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by))
            values = zip(*(batch.column(c).to_pylist() for c in reads))
            out = []
            for key, own in zip(keys, values):
                if key != group:
                    group, state = key, start()
                state, new = step(state, *own)
                out.append(new)
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = StructType([*rows.schema.fields, *made.fields])
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
