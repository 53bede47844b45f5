from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelcast.schemas import BARS
from panelcast.sinks.bar_cache import BarCache

START = date(2020, 1, 1)


def bars(spark, tickers, first, last, factor=1.0):
    rows = [(t, START + timedelta(d), 1.0 * d, 2.0 * d, 0.5 * d, factor * d, 100.0) for t in tickers for d in range(first, last)]
    return spark.createDataFrame(rows, BARS)


def closes(df):
    rows = df.collect()
    out = {(r.ticker, r.date): r.Close for r in rows}
    assert len(out) == len(rows)  # one row per key
    return out


@pytest.fixture
def cache(spark, tmp_path):
    return BarCache(spark, str(tmp_path / "bars"), buckets=8)


def test_append_and_correct(spark, cache):
    names = [f"T{i}" for i in range(20)]
    assert closes(cache.read()) == {}
    cache.upsert(bars(spark, names, 0, 10))
    before = cache.manifest()
    touched = cache.upsert(bars(spark, ["T3"], 5, 15, factor=7.0))
    version, buckets, folders = cache.manifest()
    expected = {(t, START + timedelta(d)): 1.0 * d for t in names for d in range(10)}
    expected |= {("T3", START + timedelta(d)): 7.0 * d for d in range(5, 15)}
    assert closes(cache.read()) == expected
    assert (version, buckets, len(touched)) == (2, 8, 1)
    # All other buckets are where they were.
    assert {b for b in folders if folders[b] != before[2].get(b)} == set(touched)


def test_reading_few_tickers_opens_their_buckets_only(spark, cache):
    cache.upsert(bars(spark, [f"T{i}" for i in range(40)], 0, 3))
    few = cache.read(["T1", "NONE"])
    assert set(closes(few)) == {("T1", START + timedelta(d)) for d in range(3)}
    assert len({f.rsplit("/", 2)[1] for f in few.inputFiles()}) <= 2 < len(cache.manifest()[2])


def test_repeats_nulls_and_empty_batches(spark, cache):
    row = lambda t, d, c: (t, d, 1.0, 1.0, 1.0, c, 1.0)
    odd = [row("A", START, 2.0), row("A", START, 3.0), row(None, START, 1.0), row("A", None, 1.0), row("B", START, float("nan"))]
    assert cache.upsert(spark.createDataFrame([], BARS)) == [] and cache.manifest()[0] == 0
    cache.upsert(spark.createDataFrame(odd, BARS).withColumn("bucket", F.lit("x")).withColumn("row", F.lit(1)))
    assert closes(cache.read()) == {("A", START): 3.0, ("B", START): None}
    cache.upsert(spark.createDataFrame([row("A", START, None)], BARS))
    assert closes(cache.read()) == {("A", START): None, ("B", START): None}
    assert cache.upsert(spark.createDataFrame([], BARS)) == [] and cache.manifest()[0] == 2


def test_an_existing_cache_keeps_its_bucket_count(spark, cache):
    cache.upsert(bars(spark, ["A", "B"], 0, 2))
    other = BarCache(spark, cache.path, buckets=3)
    other.upsert(bars(spark, ["A", "C"], 1, 4))
    assert other.manifest()[1] == 8 and len(closes(other.read())) == 2 + 4 + 3


def test_fetching_asks_for_what_is_missing(spark, cache):
    asked = []

    def fetch(names):
        asked.append(sorted(r.ticker for r in names.collect()))
        return bars(spark, asked[-1], 0, 2, factor=float(len(asked)))

    want = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    assert len(closes(cache.fetch_through(want("A", "B", "A", None), fetch))) == 4
    assert len(closes(cache.fetch_through(want("B", "C"), fetch))) == 4
    cache.fetch_through(want("A", "C"), fetch)
    assert asked == [["A", "B"], ["C"]]
    renewed = closes(cache.fetch_through(want("A"), fetch, refresh=True))
    assert asked[-1] == ["A"] and renewed[("A", START + timedelta(1))] == 3.0
