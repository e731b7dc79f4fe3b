"""Sequential operators as one ordered pass with carried state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybreak.session import ship


#: Rows that are Python objects at a time, and bytes of a batch.
HELD_ROWS, HELD_BYTES = 128, 4 << 20


def ordered_scan(rows: DataFrame, keys: list[str], order: list[str], out: str, start: Callable[[tuple], Callable[[tuple], object]]) -> DataFrame:
    """The rows with one more column `out` ("name type"), made by a step function over each key's rows in order.

    start is called with a key's first row and gives its step. A key's rows pass one after the other, so only the
    step's own state is held, however many there are; keys are dealt by hash.
    """
    ship(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(HELD_BYTES))
    places = [rows.columns.index(k) for k in keys]
    name, kind = out.split(" ", 1)
    arrow = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[kind]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, step = None, None
        for batch in batches:
            made = []
            for at in range(0, batch.num_rows, HELD_ROWS):
                for row in zip(*(c.slice(at, HELD_ROWS).to_pylist() for c in batch.columns)):
                    key = tuple(row[k] for k in places)
                    if step is None or key != known:
                        known, step = key, start(row)
                    made.append(step(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], [*batch.schema.names, name])

    ordered = rows.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(scan, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), out]))
