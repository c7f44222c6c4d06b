"""Folds over groups whose rows stream through a task in order: the state is kept, the group isn't."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, group: str, order: list[str], read: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """``rows`` with the columns ``out``, which ``step(state, *values of read)`` gives row by row.

    ``start()`` makes a group's state, which ``step`` may change.  A task sorts its rows (and spills), and holds
    one state and one batch of rows, however long a group is.
    """
    added = StructType.fromDDL(out)
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, first = None, None, True
        for batch in batches:
            found = []
            for g, *values in zip(*(batch.column(c).to_pylist() for c in [group, *read])):
                if first or g != last:
                    last, state, first = g, start(), False
                found.append(step(state, *values))
            columns = list(zip(*found)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*batch.schema.names, *added.names])

    ordered = rows.repartition(group).sortWithinPartitions(group, *order)
    return ordered.mapInArrow(run, StructType([*rows.schema.fields, *added.fields]))
