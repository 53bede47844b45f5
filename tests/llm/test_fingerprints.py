import hashlib
import re

import pytest
from pyspark.sql import functions as F

from panelcast.llm import fingerprints as fp
from tests.llm.conftest import prose


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def edited(rows):
    """Restates the edit: the next text by descending id, the last one going on at the first."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = {}
    for j, (i, text, _) in enumerate(order):
        text, other = text or "", order[(j + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.setdefault(i, []).append(hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest())
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("chars", [50, 400, 10**6])
def test_edits_agree_with_a_plain_sort(make_docs, odd_rows, monkeypatch, chars):
    monkeypatch.setattr(fp, "CHARS_PER_BUCKET", chars)  # many buckets, some, one
    rows = [r for r in odd_rows if r[0] is not None] + [(10 * i * i, prose(i, 5 + i % 40), "a") for i in range(2, 60)]
    rows = [r for r in rows if len(r[1] or "") < 10_000 or chars > 50]
    found = {}
    for r in fp.compare_with_edit(make_docs(rows)).collect():
        found.setdefault(r.doc_id, []).append(r.edited_sha256)
    assert {i: sorted(v) for i, v in found.items()} == edited(rows)


def test_odd_tables(make_docs, odd_rows):
    rows = fp.compare_with_edit(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert fp.compare_with_edit(make_docs([]).limit(0)).count() == 0
    one = fp.compare_with_edit(make_docs([(3, "ab", "x")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"aa").hexdigest()
    assert fp.compare_with_edit(make_docs([(None, "ab", "x"), (None, "ab", "x")])).count() == 2


def test_estimates_and_merging(spark):
    rng_words = prose(9, 4000).split()
    parts = [" ".join(rng_words[i : i + 1200]) for i in (0, 600, 1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(parts)], "doc_id int, text string")
    sketched = fp.sketch_documents(df).cache()
    a, b = sketched.filter("doc_id = 0").select(F.col("sketch").alias("a")), sketched.filter("doc_id = 1").select(F.col("sketch").alias("b"))
    got = a.join(b).select(fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"),
                           fp.distinct_shingles(F.col("a")).alias("n"), fp.resemblance(F.col("a"), F.col("a")).alias("same")).first()
    sa, sb = shingles(parts[0]), shingles(parts[1])
    assert abs(got.j - len(sa & sb) / len(sa | sb)) < 0.15 and abs(got.c - len(sa & sb) / len(sa)) < 0.2
    assert abs(got.n - len(sa)) < 0.3 * len(sa) and got.same == 1.0
    merged = fp.merge_parts(sketched.withColumn("part", F.lit(1)), ["part"]).first().sketch
    hashes = sorted({h for r in sketched.collect() for h in r.sketch})[: fp.K]
    assert merged == hashes


def test_equal_and_empty_texts(make_docs):
    rows = {r.doc_id: r.f for r in fp.sketch_documents(make_docs([(1, "a b", "x"), (2, "a  b", "x"), (3, None, "x"), (4, "", "x"), (5, "b a", "x")])).select(
        "doc_id", fp.encoded(F.col("sketch")).alias("f")).collect()}
    assert rows[1] == rows[2] != rows[5] and rows[3] == rows[4] == ""
