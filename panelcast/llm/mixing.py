"""Mixing sources to target weights by Poisson replication.

A source with weight w of the mix and mass m (code points, plus one separator a document) out of a
total M is repeated at the mean rate epochs * w * M / m. Each document draws its number of copies
from the Poisson distribution with that mean by inverting it at a hash of seed and id, so the draw
needs no state, no order and no second pass, and a task that is run again draws the same. Copies are
then dealt out by a hash of their own, which is the global shuffle.

Rates above CHUNK are the sum of several draws with smaller means, since sums of Poisson draws are
Poisson and the inversion tables stay short.

Defined results: a null text has mass 1; null sources are a source; sources without a target have
weight 0 and leave the mix; repeated rows draw alike, rows with a null id too; input columns named
like an added one (copy, copies, rate, shuffle_key) are replaced; an empty table stays empty. No cap is
set on copies: a tiny source with a large weight is repeated as often as its weight asks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import whole
from panelcast.plans.materialize import materialize

CHUNK = 32.0
MOST_BROADCAST = 1_000  # rates of about 1.5 kB each
SALTS = 64
ADDED = ["copy", "copies", "rate", "shuffle_key"]


def hashed(seed: int, *parts: Column, digits: int = 13) -> Column:
    """A whole number below 16^digits from the SHA-256 of seed and parts."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, by: str = "source", text: str = "text") -> DataFrame:
    """source, n_docs, mass and rate of each source; weights: by source name, None for equal ones."""
    masses = materialize(docs.groupBy(F.col(f"`{by}`").alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length(whole(text)).cast("long") + 1).alias("mass")), "mix-masses")
    mix = masses.agg(F.sum("mass").alias("total"), F.count(F.lit(1)).alias("n_sources")).first()
    if weights is None:
        weight = F.lit(1.0 / max(1, mix.n_sources))
    else:
        share = sum(weights.values())
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), w / share).otherwise(weight)
    return masses.select("source", "n_docs", "mass", (epochs * weight * F.lit(mix.total or 0) / F.col("mass")).alias("rate"))


def with_inversion(rates: DataFrame) -> DataFrame:
    """rates with `draws` and `cdf`: the cumulative distribution of one draw, to where it ends in doubles."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))
    most = int(CHUNK + 12 * math.sqrt(CHUNK) + 20)
    first = F.exp(-F.col("mean"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["cdf"], acc["c"] + p).alias("cdf"))

    table = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["cdf"]
    return rates.withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws")).withColumn("cdf", table).drop("mean")


def copies_drawn(id: Column, seed: int) -> Column:
    """Poisson draws of the columns `draws` and `cdf`: how many values of the table are at or below a uniform number."""
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= hashed(seed, id, j) / F.lit(float(16**13))))
    return F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda acc, j: acc + one(j))


def mix_sources(
    docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, seed: int = 17,
    by: str = "source", id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The mixed corpus in its shuffled order: all columns of docs, then copy (from 1), copies, rate, shuffle_key."""
    columns = [c for c in docs.columns if c not in ADDED]
    rates = with_inversion(source_rates(docs, weights, epochs, by, text)).select(F.col("source").alias("__source"), "rate", "draws", "cdf")
    # Drawn by id and text, so that rows without an id, or with one id in common, draw and go their own ways.
    drawn_by = F.concat_ws(":", F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("-")), F.sha2(whole(f"`{text}`"), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(f"`{by}`").alias("__by"), drawn_by.alias("__id"))
    if rates.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        drawn = rows.join(F.broadcast(rates), F.col("__by").eqNullSafe(F.col("__source")))
    else:  # a hot source is spread over the salts
        salted = rates.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        rows = rows.withColumn("__pick", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        drawn = rows.join(salted, F.col("__by").eqNullSafe(F.col("__source")) & (F.col("__pick") == F.col("__salt")))
    counted = drawn.select("__row", "__id", "rate", copies_drawn(F.col("__id"), seed).alias("copies"))
    spread = counted.select("*", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))).alias("copy"))
    keyed = spread.withColumn("shuffle_key", hashed(seed, F.lit("place"), F.col("__id"), F.col("copy"), digits=15))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("__row.*", "copy", "copies", "rate", "shuffle_key")
