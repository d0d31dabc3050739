"""Ordered folds: sequential state per key over sorted partitions, in constant memory.

Rows are dealt by key and sorted within their partition, then streamed through Arrow batches; a
key's state lives from its first row to its last, so no group is ever held as a whole.

Rows are dealt by a hash of the key and not by the key itself: over a join on the key Spark takes such
a repartition away, and when the join becomes a broadcast at run time a key's rows stay in the tasks
of the files they came from, which no state could join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, by: list[str], order: str, schema: T.StructType, start: Callable[[], object], step: Callable, end: Callable | None = None) -> DataFrame:
    """`step(state, row)` gives (state, output rows) for each row in order, `end(key, state)` the
    output rows of a finished key; rows and outputs are tuples."""
    import pyarrow as pa

    n = len(by)
    columns = [*by, *(c for c in df.columns if c not in by)]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        made = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        key, state, live = None, None, False
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if not live or row[:n] != key:
                    if live and end:
                        out += end(key, state)
                    key, state, live = row[:n], start(), True
                state, more = step(state, row)
                out += more
            yield made(out)
        if live and end:
            yield made(list(end(key, state)))

    return df.select(*columns).repartition(F.xxhash64(*by)).sortWithinPartitions(*by, order).mapInArrow(run, schema)
