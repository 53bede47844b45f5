"""From raw documents to shuffled token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as Parquet and
hands the reread table to the next one. All stages but the last return the columns of documents.

Defined results: null and empty texts fail the first stage's rules; rows without an id are never near duplicates of others, and
rows of one id stay or go together; a null n_chars stays null unless secrets are masked in the text; a null source is a source
of its own; extra columns travel along; an empty table gives an empty result with the columns of the last stage.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import bpe, mixing, near_dedup, quality_rules, secrets
from panelcast.llm.common import table, whole
from panelcast.plans.materialize import materialize

TOKENIZER = "word_bpe_49k.json"
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    return near_dedup.deduplicated(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; no document goes. n_chars counts the masked text."""
    found = secrets.scan_secrets(docs, keep=docs.columns)
    hidden = F.when(F.size("spans") > 0, secrets.masked(whole("text"), F.col("spans"))).otherwise(F.col("text"))
    changed = found.withColumn("text", hidden)
    length = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", length).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of the mix; copies of a document are rows of their own."""
    return mixing.mix_sources(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, with the text that they decode to."""
    kept = [c for c in docs.columns if c != "text"]
    coded = bpe.encode(docs, tokenizer_path(TOKENIZER), keep=kept, decoded=True)
    return coded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing", mix),
    ("bpe", tokenise),
]

# SQL has no BPE; tests/llm/test_pipeline.py holds run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
