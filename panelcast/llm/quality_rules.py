"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a set of rules with a version name, so accepting or rejecting under
any policy, and asking what a single rule costs, are bitwise operations on the ledger.

Defined results: a null or empty text has no words and fails `few_words`; a null id stays a
null id; repeated rows give repeated ledger rows; other columns of the input are ignored, so
their names cannot clash; an empty table gives an empty ledger. Windows of three words are
compared by a 64-bit hash.
"""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import settled, whole

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


class Rule(NamedTuple):
    name: str
    fails: Callable[[], Column]  # over the measurement columns; never null


def col(name: str) -> Column:
    return F.col(name)


# The position in this list is the bit: append only, so that stored ledgers stay readable.
RULES: list[Rule] = [
    Rule("few_words", lambda: col("n_words") < 50),
    Rule("repeated_windows", lambda: 100 * col("n_repeat_words") > 50 * col("n_words")),
    Rule("symbol_density", lambda: 10 * col("n_symbols") > col("n_words")),
    Rule("word_length", lambda: (col("word_chars") < 2 * col("n_words")) | (col("word_chars") > 20 * col("n_words"))),
    Rule("repeated_lines", lambda: 10 * col("n_dup_lines") > 3 * col("n_lines")),
    Rule("exclamations", lambda: 10 * col("n_exclaims") > col("n_words")),
    Rule("capitals", lambda: 2 * col("n_capitals") > col("word_chars")),
    Rule("few_letters", lambda: 2 * col("n_marks") > col("word_chars")),
]

# Policies never change once released; a new version is a new name.
POLICIES: dict[str, list[str]] = {
    "base-1": ["few_words", "repeated_windows"],
    "prose-1": ["few_words", "repeated_windows", "symbol_density", "word_length", "repeated_lines"],
    "prose-2": ["few_words", "repeated_windows", "symbol_density", "word_length", "exclamations", "capitals"],
    "strict-1": [r.name for r in RULES],
}
CURRENT = "prose-2"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals", "n_marks"]


def mask(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _removed(pattern: str) -> Column:
    return (F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))).cast("long")


def _measure(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    df = docs.select(*[F.col(f"`{k}`") for k in keep], whole(text).alias("__text"))
    df = df.withColumns({
        "__words": F.array_remove(F.split("__text", SPACE), ""),
        "__lines": F.split("__text", "\n"),
    })
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _removed(SYMBOLS),
        "n_exclaims": _removed("!+"),
        "n_capitals": _removed(r"\p{Lu}+"),
        "n_marks": _removed(r"[\x21-\x40\x5B-\x60\x7B-\x7E]+"),
        "n_lines": F.size("__lines").cast("long"),
        "__worded": F.filter("__lines", lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "__windows": F.when(F.size("__words") >= 3, F.transform(
            F.slice("__words", 1, F.size("__words") - 2),
            lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)),
        )).otherwise(F.array().cast("array<bigint>")),
    })
    # Equal windows stand side by side once sorted; only texts with a repeated window pay for it.
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    df = df.withColumn("__at", F.sort_array(F.filter(F.transform("__sorted", lambda s, j: F.when(
        s.h.eqNullSafe(F.get("__sorted", j - 1).h) | s.h.eqNullSafe(F.get("__sorted", j + 1).h), s.i,
    )), lambda i: i.isNotNull())))
    covered = F.aggregate(
        F.transform("__at", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("__at", j + 1) - i, F.lit(3))).cast("long")),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    return df.withColumns({
        "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    })


def _ledger(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    measured = settled(_measure(docs, text, keep), keep, {m: F.col(m) for m in MEASURES})
    return measured.select(*keep, *MEASURES, bits.alias("fail_bits"))


def rule_ledger(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, the measurements, and fail_bits (bit i: RULES[i] failed)."""
    return _ledger(docs, text, [id])


def keyed_ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ledger with some columns of docs in place of the id."""
    return _ledger(docs, text, keep)


def accepted(policy: str = CURRENT, bits: str | Column = "fail_bits") -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(ledger: DataFrame, policy: str = CURRENT, by: list[str] | None = None) -> DataFrame:
    """What each rule of a policy does, from one aggregation over the bits.

    `failed`: rows that fail the rule; `only`: rows rejected by this rule alone, hence gained by
    dropping it; `rejected` and `total` are those of the policy. One row per group and rule.
    """
    m, names = mask(policy), [r.name for r in RULES]
    hit = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(hit != 0).alias("rejected")]
    for n in POLICIES[policy]:
        bit = F.lit(1 << names.index(n)).cast("long")
        aggs += [F.count_if(hit.bitwiseAND(bit) != 0).alias(f"failed_{n}"), F.count_if(hit == bit).alias(f"only_{n}")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("failed"), F.col(f"only_{n}").alias("only"))
        for n in POLICIES[policy]
    ])).alias("r")
    return ledger.groupBy(*(by or [])).agg(*aggs).select(*(by or []), "total", "rejected", rows).select(
        *(by or []), "r.rule", "r.failed", "r.only", "total", "rejected",
    )


def passing(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The input rows, all columns unchanged, that the policy accepts.

    All columns of a row travel inside one struct, so no column name can clash.
    """
    bundled = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__in"))
    return _ledger(bundled, "__in", ["__row"]).filter(accepted(policy)).select("__row.*")
