"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest of the distinct 48-bit hashes of a text's five-word
shingles (fewer words: the whole sequence is one shingle; no words: an empty sketch). The sketch of
a union is the k smallest of the parts' sketches, so sketches of parts merge in any order and any
number of steps. Two sketches estimate resemblance, containment and the number of distinct shingles.

Defined results: null texts are empty texts; two empty sketches are alike (1), an empty and another
are not (0); equal texts have equal sketches; null ids sort after all others; rows with equal ids
sort by text; only `id` and `text` are read, so other columns cannot clash; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.llm.common import settled, whole

K, WIDTH, BITS = 128, 5, 48
SPACE = r"[\x20\x09-\x0D]+"
CHARS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 20_000


def shingle_hashes(word_hashes: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes, from an array of word hashes held in a column of its own."""
    n = F.size(word_hashes)
    whole_text = F.array(F.aggregate(word_hashes, F.lit(0).cast("long"), lambda acc, h: F.xxhash64(acc, h)))
    running = F.transform(F.slice(word_hashes, 1, F.greatest(n - width + 1, F.lit(0))), lambda h, i: F.xxhash64(
        h, *[F.get(word_hashes, i + j) for j in range(1, width)]))
    return F.array_distinct(F.when(n >= width, running).when(n > 0, whole_text).otherwise(F.array().cast("array<bigint>")))


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))


def add_sketches(df: DataFrame, texts: dict[str, Column], k: int = K, width: int = WIDTH) -> DataFrame:
    """df with one sketch column per named text."""
    df = df.withColumns({f"__words_{n}": word_hashes(t) for n, t in texts.items()})
    short = lambda h: F.shiftrightunsigned(h, 64 - BITS)
    df = df.withColumns({n: F.slice(F.sort_array(F.transform(shingle_hashes(F.col(f"__words_{n}"), width), short)), 1, k) for n in texts})
    return df.drop(*[f"__words_{n}" for n in texts])


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group from the sketches of its parts.

    Only the k smallest hashes of a group leave each task and each step (a window group limit), so
    a group of any size ends as k rows.
    """
    rows = parts.select(*by, F.explode(sketch).alias("__h")).distinct()
    w = Window.partitionBy(*by).orderBy("__h")
    least = rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) / (largest hash as a share of the range)."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(2.0**BITS) / (F.array_max(a) + 1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest of the union that both sketches hold."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def encoded(a: Column) -> Column:
    """The sketch as text: base 64 of its hashes, six bytes each."""
    packed = F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))
    return F.regexp_replace(F.base64(packed), r"\s", "")  # without the line breaks of mail


def with_next_text(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text and next_text: that of the row after it by descending id, for the last that of the first.

    The order is cut into buckets of consecutive ids, bounded by ids that occur, and each bucket also
    gets the first row of the bucket below it (of the highest, for the lowest). So one shuffle of
    the texts by bucket gives every row its neighbour. Buckets are many more than tasks and of
    about equal length; at most MOST_BUCKETS bounds go through the driver.
    """
    rows = docs.select(F.col(f"`{id}`").alias("__id"), whole(text).alias("__text"))
    whole_table = rows.agg(F.count("__id").alias("n"), F.max("__id").alias("top"), F.sum(F.length("__text").cast("long")).alias("chars")).first()
    buckets = min(MOST_BUCKETS, (whole_table.chars or 0) // CHARS_PER_BUCKET + 1)
    bounds = [whole_table.top] if whole_table.n else []
    if whole_table.n and buckets > 1:
        cuts = [i / buckets for i in range(1, buckets)]
        found = rows.agg(F.percentile_approx("__id", cuts, max(10_000, 4 * buckets)).alias("b")).first().b
        bounds = sorted({*found, whole_table.top})
    at, steps = F.split(F.lit(",".join(map(str, bounds)) or "0"), ",").cast("array<bigint>"), max(1, len(bounds).bit_length())
    # Binary search for the first bound that is not below the id.
    half = F.struct(F.lit(0).alias("low"), F.lit(max(0, len(bounds) - 1)).alias("high"))

    def narrow(acc, _):
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = F.get(at, mid) < F.col("__id")
        return F.when(acc["low"] >= acc["high"], acc).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(mid).alias("high")))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), half, narrow)["low"]
    bucket = settled(rows, ["__id", "__text"], {"__bucket": F.when(F.col("__id").isNull() | F.lit(not bounds), 0).otherwise(place)})
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("donor"))
    lent = F.struct(F.pmod(F.col("__bucket") + 1, F.lit(max(1, len(bounds)))).alias("bucket"), F.lit(True).alias("donor"))
    first = (F.get(at, F.col("__bucket")) == F.col("__id")) if bounds else F.lit(True)
    spread = bucket.select("__id", "__text", F.explode(F.when(F.coalesce(first, F.lit(False)), F.array(own, lent)).otherwise(F.array(own))).alias("__at"))
    order = Window.partitionBy("__bucket").orderBy("__donor", F.col("__id").desc_nulls_last(), "__text")
    return (
        spread.select("__id", "__text", "__at.bucket", "__at.donor").toDF("__id", "__text", "__bucket", "__donor")
        .withColumn("__next", F.lead("__text").over(order)).filter(~F.col("__donor"))
        .select(F.col("__id").alias(id), F.col("__text").alias("text"), F.col("__next").alias("next_text"))
    )


def half_replaced(text: Column, other: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many of the other text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def sketch_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id, sketch."""
    df = add_sketches(docs.select(F.col(f"`{id}`").alias("__id"), whole(text).alias("__text")), {"__sketch": F.col("__text")}, k, width)
    return settled(df, ["__id"], {"sketch": F.col("__sketch")}).withColumnRenamed("__id", id)


def compare_with_edit(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, the edited text's SHA-256, and the sketches of the text, the edited text and the next text."""
    pairs = with_next_text(docs, id, text).withColumn("__edited", half_replaced(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("__edited", 256)})
    sketched = add_sketches(pairs, {"sketch": F.col("text"), "edited_sketch": F.col("__edited"), "next_sketch": F.col("next_text")})
    return settled(sketched, [id, "n_chars", "edited_sha256"], {c: F.col(c) for c in ("sketch", "edited_sketch", "next_sketch")})
