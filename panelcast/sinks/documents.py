"""JSON and text sinks.

Documents whose size is set by models, horizons or months are written as one file. Anything
with one entry per ticker is written as JSON lines, in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.config import MODELS
from panelcast.functions.numbers import finite_or_null

METRICS = ("pinball", "coverage", "hit_rate", "ic")
TITLE = "# Model Card — Panel Quantile Forecasts"
SUBTITLE = "Out-of-sample metrics (purged/embargoed walk-forward CV):"


def long_metrics(scores: DataFrame) -> DataFrame:
    """(model, horizon, metric, value) with non-finite values as null."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), finite_or_null(m).alias("value")) for m in METRICS])
    return scores.select("model", "horizon", F.explode(each).alias("m")).select("model", "horizon", "m.metric", "m.value")


def flat_metrics(scores: DataFrame) -> DataFrame:
    """(key, value) with keys model/y_horizon/metric, for a metric log."""
    return long_metrics(scores).select(F.concat_ws("/", "model", F.concat(F.lit("y_"), "horizon"), "metric").alias("key"), "value")


def metrics_document(scores: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """One row, one JSON text: model -> y_horizon -> metric, plus blend weights and deltas."""
    per_metric = F.struct(*[finite_or_null(m).alias(m) for m in METRICS])
    models = (
        scores.select("model", F.concat(F.lit("y_"), "horizon").alias("h"), per_metric.alias("m"))
        .groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("h", "m")))).alias("entry"))
        .select(F.col("model").alias("k"), _json(F.col("entry")).alias("v"))
    )
    parts = models
    if params is not None:
        each = F.array(
            F.struct(F.lit("blend_weight").alias("k"), F.col("w").alias("x")),
            F.struct(F.lit("conformal_delta").alias("k"), F.col("delta").alias("x")),
        )
        scalars = params.select("horizon", F.explode(each).alias("e")).where(F.col("e.x").isNotNull())
        parts = parts.unionByName(
            scalars.groupBy(F.col("e.k").alias("k"))
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon", finite_or_null("e.x"))))).alias("entry"))
            .select("k", _json(F.col("entry")).alias("v"))
        )
    members = F.transform(
        F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: F.concat(F.lit('"'), e["k"], F.lit('": '), e["v"])
    )
    return parts.agg(F.concat(F.lit("{"), F.concat_ws(",\n ", members), F.lit("}")).alias("value"))


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def model_card(scores: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(ord, value): the lines of the model card, n/a for undefined values."""

    def shown(c: str) -> Column:
        v = finite_or_null(c)
        return F.when(v.isNull(), F.lit("n/a")).otherwise(F.format_string("%.4f", v))

    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("section")), F.lit(0))
    metric_line = F.concat(
        F.lit("- y_"), F.col("horizon"), F.lit(": "),
        F.concat_ws(", ", *[F.concat(F.lit(f"{m}="), shown(m)) for m in METRICS]),
    )
    lines = scores.select(F.col("model").alias("section"), "horizon", metric_line.alias("value"))
    if params is not None:
        for name, c in (("blend_weight", "w"), ("conformal_delta", "delta")):
            extra = F.concat(F.lit("- "), F.col("horizon"), F.lit(": "), shown(c))
            lines = lines.unionByName(params.select(F.lit(name).alias("section"), "horizon", extra.alias("value")))
    heads = lines.select("section").distinct().select("section", F.lit("").alias("horizon"), F.concat(F.lit("## "), "section").alias("value"))
    title = lines.sparkSession.createDataFrame(
        [("", "0", TITLE), ("", "1", ""), ("", "2", SUBTITLE), ("", "3", "")], "section string, horizon string, value string"
    )
    order = F.struct(
        F.when(F.col("section") == "", 0).when(F.col("section").isin(list(MODELS)), rank).otherwise(F.lit(len(MODELS) + 1)),
        "section", "horizon",
    )
    return title.unionByName(lines).unionByName(heads).select(order.alias("ord"), "value")


def write_model_card(scores: DataFrame, path: str, params: DataFrame | None = None) -> None:
    card = model_card(scores, params).repartition(1).sortWithinPartitions("ord").select("value")
    card.write.mode("overwrite").text(path)


def write_one_document(doc: DataFrame, path: str) -> None:
    """Write a bounded one-row document: its text column, or the row itself as JSON."""
    text = doc.select("value") if doc.columns == ["value"] else doc.select(_json(F.struct("*")).alias("value"))
    text.repartition(1).write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """One JSON record per line, nulls kept, written by all tasks."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
