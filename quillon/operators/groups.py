"""Functions over small groups, a sorted partition at a time: one exchange, and no cost per group but the function's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are put out together, at least.
ROWS = 10_000


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], f: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """f(key, rows in order) gives rows of schema for each group of equal keys. A group is held by one task while it is
    worked on; rows hold the columns of df that are no keys."""
    names = [*keys, *(c for c in df.columns if c not in keys)]
    k = len(keys)
    fields = S.StructType.fromDDL(schema).fields
    columns, types = [x.name for x in fields], [to_arrow_type(x.dataType) for x in fields]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:k] != key:
                    if group:
                        out += f(key, group)
                        if len(out) >= ROWS:
                            yield batch(out)
                            out = []
                    key, group = row[:k], []
                group.append(row[k:])
        if group:
            out += f(key, group)
        yield batch(out)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
