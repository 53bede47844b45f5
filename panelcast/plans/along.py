"""One pass along whole series in NumPy: rows come ordered by key, work sees one series at a time.

A key has at most one row per calendar day, which bounds a series (see functions/windows.py). Windows over every row cost a sort buffer
and a copy of the row each; here all steps of a series share one trip out of the JVM and back. Works that follow each other
run in the same pass: what along_series returns remembers its source, until it is filtered or selected from.

The rows lose Spark's knowledge of how they are dealt, so a window by key after the pass needs an exchange: do such work in the pass.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelcast.functions.windows import series

Series = dict[str, np.ndarray]  # columns of one series; numbers, dates (as days) and flags are doubles, NaN for null
Work = Callable[[Series], "dict | None"]
_START = "__n"


def along_series(df: DataFrame, work: Work, fields: list[T.StructField], key: str = "ticker", order: str = "date") -> DataFrame:
    """(key, fields): the rows that work makes of each series of df, in their order; df's other columns are numbers, dates and flags.

    work gets the columns of a whole series in the order of `order` and returns columns of one length, which may be another
    one; None stands for no rows. A column may be an Arrow array. Null keys make a series, as they do in a window.
    """
    source, works = getattr(df, "along", {}).get((key, order), (None, []))
    if source is None:
        # The window deals and orders the rows, unless they are, and numbers them, which marks where series start.
        source = df.withColumn(_START, F.row_number().over(series(key, order)))
    schema = T.StructType([df.schema[key], *fields])
    works = [*works, work]
    out = source.mapInArrow(_runner(works, key, schema), schema)
    out.along = {(key, order): (source, works)}
    return out


def _runner(works: list[Work], key: str, schema: T.StructType):
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields if f.name != key]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(_START).to_numpy() == 1)
            if not len(starts):
                held.append(batch)
                continue
            yield from worked([*held, batch.slice(0, starts[-1])])
            held = [batch.slice(starts[-1])]
        yield from worked(held)

    def worked(held: list[pa.RecordBatch]):
        held = [b for b in held if b.num_rows]
        if not held:
            return
        rows = pa.concat_batches(held)
        starts = np.flatnonzero(rows.column(_START).to_numpy() == 1)
        columns = {n: _vector(rows.column(n)) for n in rows.schema.names if n not in (key, _START)}
        made, counts = [], []
        with np.errstate(all="ignore"):
            for a, b in zip(starts, [*starts[1:], rows.num_rows]):
                s = {n: x[a:b] for n, x in columns.items()}
                for work in works:
                    s = work(s) if s is not None else None
                if s is not None:
                    made.append(s)
                counts.append(len(next(iter(s.values()))) if s is not None else 0)
        if made and sum(counts):
            keys = rows.column(key).take(pa.array(np.repeat(starts, counts)))
            arrays = {key: keys} | {n: _array([s[n] for s in made], kind) for n, kind in kinds}
            yield pa.RecordBatch.from_pydict({n: arrays[n] for n in schema.names}, schema=pa.schema([(f.name, arrays[f.name].type) for f in schema.fields]))

    return run


def _vector(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for null; dates as days since 1970."""
    if pa.types.is_date(column.type):
        column = column.cast(pa.int32())
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _array(parts: list, kind: pa.DataType) -> pa.Array:
    if isinstance(parts[0], pa.Array):
        return pa.concat_arrays([p.cast(kind) for p in parts])
    x = np.concatenate(parts)
    if kind == pa.float64():
        return pa.array(x, kind, from_pandas=True)
    if x.dtype == bool:
        return pa.array(x, kind)
    missing = np.isnan(x)
    whole = pa.array(np.where(missing, 0, x).astype(np.int64), mask=missing)
    return whole.cast(pa.int32()).cast(kind) if pa.types.is_date(kind) else whole.cast(kind)


def doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def picked(s: Series, rows: np.ndarray) -> Series:
    """The rows of a series that a mask picks."""
    at = np.flatnonzero(rows)
    if len(at) and at[-1] - at[0] == len(at) - 1:
        return {n: x[at[0] : at[-1] + 1] for n, x in s.items()}
    return {n: x[at] for n, x in s.items()}
