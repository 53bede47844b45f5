"""A bar cache that adds and corrects: one row per (ticker, date), and only the touched parts rewritten.

Tickers are spread over a fixed number of buckets by hash. A manifest names, for each bucket, the folder that holds its
rows now. An upsert reads and rewrites the buckets of its tickers, then adds a manifest of the next version, so readers
see the old table or the new one. It is made for one writer at a time; a second one that started from the same version
fails once the first has written its manifest.

Hash buckets need no bounds that pass through the driver, and a ticker has at most one row per calendar day, so no bucket
grows by one hot ticker. The manifest has at most `buckets` rows.

Defined results: of rows repeated in one batch the greatest (by open, high, low, close, volume) is kept; a later batch
replaces whole rows, nulls included; rows without ticker or date cannot be addressed and are left out; an empty batch
adds no version; columns other than key and OHLCV are not kept.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelcast.functions.numbers import nan_to_null
from panelcast.schemas import BARS, OHLCV

BUCKETS = 256
_ENTRY = "bucket int, buckets int, folder string"
_MANIFEST = f"{_ENTRY}, version long"


class BarCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """`buckets` counts for a new cache only; an existing one keeps its own."""
        self.spark, self.path = spark, path.rstrip("/")
        self._new_buckets = buckets

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> tuple[int, int, dict[int, str]]:
        """(version, buckets, folder of each bucket in use); version 0 is a cache without rows."""
        if not self._exists(f"{self.path}/manifest"):
            return 0, self._new_buckets, {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        newest = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).collect()
        return newest[0].version, newest[0].buckets, {r.bucket: r.folder for r in newest}

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], BARS)
        return self.spark.read.schema(BARS).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, tickers: list[str] | None = None) -> DataFrame:
        """The bars of all tickers, or of the given few, whose buckets alone are read."""
        _, buckets, folders = self.manifest()
        if tickers is None:
            return self._rows([folders[b] for b in sorted(folders)])
        named = self.spark.createDataFrame([(t,) for t in tickers], "ticker string")
        wanted = {r.b for r in named.select(self._bucket(buckets).alias("b")).distinct().collect()}
        return self._rows([folders[b] for b in sorted(wanted & set(folders))]).where(F.col("ticker").isin(tickers))

    def upsert(self, bars: DataFrame) -> list[int]:
        """Add new rows and replace those with a known (ticker, date). Returns the buckets rewritten.

        The batch is read twice; write it out first where it is costly to compute or may change between reads.
        """
        version, buckets, folders = self.manifest()
        values = [nan_to_null(F.col(c).cast("double")).alias(c) for c in OHLCV]
        batch = bars.where("ticker IS NOT NULL AND date IS NOT NULL").select("ticker", "date", *values)
        touched = sorted(r.b for r in batch.select(self._bucket(buckets).alias("b")).distinct().collect())
        if not touched:
            return []
        row = F.struct(*OHLCV)
        known = self._rows([folders[b] for b in touched if b in folders]).select("ticker", "date", F.lit(0).alias("batch"), row.alias("row"))
        fresh = batch.select("ticker", "date", F.lit(1).alias("batch"), row.alias("row"))
        latest = known.unionByName(fresh).groupBy("ticker", "date").agg(F.max(F.struct("batch", "row")).alias("last"))
        placed = latest.select("ticker", "date", "last.row.*", self._bucket(buckets).alias("bucket"))
        part = f"rows-{uuid.uuid4().hex}"
        ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "ticker", "date")
        ordered.write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.path}/{part}")
        now = {**folders, **{b: f"{part}/bucket={b}" for b in touched}}
        entries = [(b, buckets, f) for b, f in sorted(now.items())]
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("errorifexists").parquet(
            f"{self.path}/manifest/version={version + 1}")
        return touched

    def fetch_through(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], refresh: bool = False) -> DataFrame:
        """Bars of the wanted tickers; `fetch` is asked, once, for those that the cache lacks (all of them on refresh)."""
        names = wanted.select("ticker").where("ticker IS NOT NULL").distinct()
        lacking = names if refresh else names.join(self.read().select("ticker").distinct(), "ticker", "left_anti")
        if not lacking.isEmpty():
            self.upsert(fetch(lacking))
        return self.read().join(names, "ticker", "left_semi")
