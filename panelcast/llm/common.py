"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import sys
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


BATCH_SETTING, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text itself, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def settled(df: DataFrame, keep: list[str], computed: dict[str, Column]) -> DataFrame:
    """Select columns so that the computed ones are evaluated exactly once per row.

    A filter over a computed column is otherwise pushed below the projections, which writes the
    whole expression out again at each mention, inside lambdas even once per array element. The
    optimiser does not push through a generator, so a one-row generator ends that.
    """
    row = F.struct(*[c.alias(n) for n, c in computed.items()])
    return df.select(*[F.col(f"`{k}`") for k in keep], F.inline_outer(F.array(row)))


def smallest_hashes(rows: DataFrame, key: str | list[str], most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of the key (one column or several); `__hash` is appended.

    A cut of the hash range comes first, so that about 2 * most rows in all leave the tasks, where
    a plain top-k would send that many from each.
    """
    hashed = rows.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(*([key] if isinstance(key, str) else key)), 1))
    n = rows.count()
    if n > 2 * most:
        hashed = hashed.filter(F.col("__hash") < int(2 * most / n * 2**63))
    return hashed.orderBy("__hash").limit(most)


def give_back() -> None:
    """Return memory that is free in this process, Arrow's and the C library's, to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def map_texts(
    df: DataFrame, text: str, keep: list[str], fields: str,
    work: Callable[..., list[list]], chunk_bytes: int = 4_000_000, given: list[Column] | None = None,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply work to whole texts inside the tasks and append its columns to `keep`.

    work takes UTF-8 texts (null becomes empty), then one list of values per column of `given`, and
    returns one list of values per field of the DDL string `fields`. Batches are cut by bytes, on their way
    out of the JVM (where that setting was left alone) and again here, so that memory does not follow the
    number of long texts in a batch; a single text is never cut. The map has no state across rows: a lost task
    is simply run again. Workers outlive their tasks, so at the end of a task `done` may empty what work has
    cached, and free memory is given back.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, DEFAULT_BATCH) == DEFAULT_BATCH:  # a session's own choice stays
        conf.set(BATCH_SETTING, BATCH_BYTES)
    extra = T.StructType.fromDDL(fields)
    source = df.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keep)], whole(text).cast("binary").alias("__text"),
                       *[c.alias(f"__g{i}") for i, c in enumerate(given or [])])
    kept = [T.StructField(k, df.schema[k].dataType, True) for k in keep]
    schema = T.StructType(kept + extra.fields)
    width = len(given or [])

    def parts(batches):
        types = [to_arrow_type(f.dataType) for f in extra.fields]
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("__text")).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + chunk_bytes, side="right")))
                part = batch.slice(start, end - start)
                made = work(part.column("__text").to_pylist(), *[part.column(f"__g{i}").to_pylist() for i in range(width)])
                arrays = [part.column(i) for i in range(len(kept))] + [
                    m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, types)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
                start = end

    def run(batches):
        try:
            yield from parts(batches)
        finally:
            if done:
                done()
            give_back()

    return source.mapInArrow(run, schema)
