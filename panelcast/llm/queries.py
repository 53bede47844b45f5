"""Registered queries of this subpackage: each takes (spark, data folder) and returns a DataFrame."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from public_tokenizers import path as tokenizer_path

from panelcast.llm import bpe, fill_in_middle, fingerprints, gam, html_extract, licenses, mixing, near_dedup, quality_rules, secrets, tool_calls, toxicity, vector_codes
from panelcast.llm.common import table
from panelcast.plans.materialize import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_quality_rules(spark, sf):
    ledger = quality_rules.rule_ledger(table(spark, sf, "documents"))
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.accepted("base-1")).alias("base_failed"),
        quality_rules.accepted().alias("kept"),
        "fail_bits",
    )


@query
def rule_ablation(spark, sf):
    """What each rule of the current policy rejects, and rejects alone, by source."""
    docs = table(spark, sf, "documents")
    ledger = quality_rules.keyed_ledger(docs, ["source"])
    return quality_rules.ablation(ledger, by=["source"])


@query
def op5_bpe(spark, sf):
    coded = bpe.encode(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_licenses(spark, sf):
    return licenses.license_summary(licenses.scan_licenses(table(spark, sf, "documents")))


@query
def op3_secrets(spark, sf):
    found = secrets.scan_secrets(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"),
    )


@query
def op4_fingerprints(spark, sf):
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return fingerprints.compare_with_edit(table(spark, sf, "documents")).select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.encoded(own).alias("fingerprint"), fingerprints.encoded(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"), fingerprints.resemblance(own, following).alias("near_next"),
        fingerprints.distinct_shingles(own).alias("n_shingles_estimate"),
    )


@query
def op8_mixing(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"))


@query
def op10_tool_calls(spark, sf):
    linked = tool_calls.linked_turns(table(spark, sf, "conversations"))
    return linked.withColumn("errors", F.array_join("errors", ","))


@query
def op9_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query
def op2_quality_gam(spark, sf):
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = gam.fit_on(docs, labels.filter(~held_out))
    return gam.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op7_html(spark, sf):
    pages = table(spark, sf, "pages")
    found = html_extract.extract(pages, html_extract.train_labeller(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op12_fill_in_middle(spark, sf):
    made = fill_in_middle.fill_in_middle(table(spark, sf, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


@query
def op11_vector_codes(spark, sf):
    coded, books = vector_codes.compress(table(spark, sf, "embeddings"), keep=["label"])
    coded = vector_codes.with_group_sum(materialize(coded, "vector-codes"), "label", "error", "label_error")
    hexed = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")))
    return coded.select(
        "vec_id", F.array_join(hexed, "").alias("code"), "error", "label_error",
        F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256"),
    )


@query
def op13_toxicity(spark, sf):
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit_on(docs, labels.filter(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
