"""Folds over the ordered rows of a key, in memory that doesn't grow with the key."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Stands for not-a-number, which Python finds unequal to itself.
_NAN = object()


def folded(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterable[tuple]], Iterator[tuple]], out: str, batch_rows: int = 8192) -> DataFrame:
    """keys and the columns of out: what fold yields for each key, given its other columns' rows as an iterator.

    Spark sorts and spills; a task sees one Arrow batch at a time, so a key of any
    size needs no more memory than fold keeps. df has keys and order first, then
    what else fold reads. Keys are compared as Spark groups them: null is a key, and
    so is not-a-number.
    """
    rest = [c for c in df.columns if c not in keys]
    schema = StructType([df.schema[k] for k in keys] + _parse_datatype_string(out).fields)
    arrow, width = to_arrow_schema(schema), len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done: list[tuple] = []
        for key, group in groupby(rows, lambda r: tuple(_NAN if x != x else x for x in r[:width])):
            key = tuple(math.nan if x is _NAN else x for x in key)
            for got in fold(r[width:] for r in group):
                done.append(key + got)
                if len(done) == batch_rows:
                    yield batch(done)
                    done = []
        if done:
            yield batch(done)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
