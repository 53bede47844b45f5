r"""Secret scans: known shapes, and a randomness test battery for strings of no known shape.

Known shapes (base kinds) are matched leftmost and without overlap, each kind by itself:
`assign` (a secret-like name, a sign, a value of 6 or more), `access` (access key ids) and `hex`.

The battery takes every run of 16 or more characters of [A-Za-z0-9+/_-]. Base spans are cut out of
it, and every remaining piece of 16 or more characters is tested by itself, without the mark that
joined it to a base span. The encoding is inferred from its characters (hexadecimal, base 32,
base 64) and gives the alphabet. Under the hypothesis "drawn uniformly from this alphabet" three
tests are made: chi-squared uniformity, runs of character classes, and serial correlation; Fisher's
method combines them. Identifiers and prose are far from uniform and are dismissed; what cannot be
dismissed is reported as `random`. Dismissals are the discoveries: their false rate over the whole
corpus is held by the Benjamini-Hochberg procedure with weights 1/length, since tests on short
strings are weak. Its threshold comes from a histogram of at most a few thousand bins.

Defined results: null and empty texts have no spans; a null id stays null; repeated rows are
scanned (and count in the histogram) each; `keep` names the columns kept; an empty table stays
empty. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import settled, whole

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 or more characters in all
HEX = r"[0-9a-f]{24,}"
LEAST_RUN = 16
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}"
MARKS = "[+/_-]"
KINDS = ["assign", "access", "hex", "random"]
MIN_VALUE = 6

FALSE_DISMISSALS = 0.01
BINS_PER_OCTAVE = 16
LEAST_P = 1e-30

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# name, test of the whole string, alphabet (as upper case, then lower, then digits, then marks)
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"", UPPER + LOWER + DIGITS + "-_"),
]


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Matches of a pattern as (start, kind, end, value); the gaps between matches give the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    values = found if value_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    item = lambda at, end, value: F.struct(
        at.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), value.alias("value"))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.filter(F.array(item(F.lit(0), F.lit(0), F.lit(""))), lambda x: F.lit(False)).alias("spans"))

    def step(acc, s):
        at = acc["at"] + F.length(s["gap"])
        end = at + F.length(s["found"])
        return F.when(s["found"].isNull(), acc).otherwise(
            F.struct(end.cast("long").alias("at"), F.array_append(acc["spans"], item(at, end, s["value"])).alias("spans")))

    return F.when(text.rlike(pattern), F.aggregate(steps, empty, step)["spans"]).otherwise(empty["spans"])


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by Hastings' rational approximation."""

    def at(z: Column) -> Column:
        t = 1 / (1 + 0.2316419 * F.abs(z))
        powers = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
        series = sum((c * F.pow(t, F.lit(i + 1.0)) for i, c in enumerate(powers)), F.lit(0.0))
        tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
        return F.when(z >= 0, tail).otherwise(1 - tail)

    return F.get(F.transform(F.array(z), at), F.lit(0))  # inside the lambda z is a value, evaluated once


def _bounded(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(LEAST_P), p))


def _encoding(s: Column) -> Column:
    """The index in ENCODINGS: the first whose test the whole string meets."""
    found = F.lit(len(ENCODINGS) - 1)
    for i, (_, test, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        found = F.when(s.rlike(test), i).otherwise(found)
    return found


def _of(values: list, encoding: Column) -> Column:
    return F.element_at(F.lit(values), encoding + 1)


def randomness(s: Column, encoding: Column) -> Column:
    """The combined p-value of "uniform over the alphabet of the encoding" for one string."""
    alphabets = [a for _, _, a in ENCODINGS]
    classes = [UPPER, LOWER, DIGITS, "+/_-"]
    # The chance that two drawn characters are of one class.
    same = _of([sum((sum(c in group for c in a) / len(a)) ** 2 for group in classes) for a in alphabets], encoding)
    alphabet, k = _of(alphabets, encoding), _of([float(len(a)) for a in alphabets], encoding)
    n, df = F.length(s).cast("double"), k - 1
    # counts by removal: how much shorter the string gets without the character
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.pow(
        (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"), F.lit(2.0)))
    spread = 2 / (9 * df)
    z_chi = (F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    runs = sum((F.regexp_count(s, F.lit(c)) for c in ("[a-z]+", "[0-9]+", "[+/_-]+")), F.regexp_count(s, F.lit("[A-Z]+")))
    z_runs = (runs - 1 - (n - 1) * (1 - same)) / F.sqrt((n - 1) * same * (1 - same))
    # serial correlation of the characters' numbers, whose mean and variance the alphabet fixes
    codes = F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c) - (k + 1) / 2)
    products = F.aggregate(
        F.zip_with(codes, F.slice(codes, 2, F.length(s)), lambda x, y: x * F.coalesce(y, F.lit(0.0))),
        F.lit(0.0), lambda acc, x: acc + x)
    z_serial = products / (F.sqrt(n - 1) * (k * k - 1) / 12)
    logs = -(F.log(_bounded(_tail(z_chi))) + F.log(_bounded(2 * _tail(F.abs(z_runs)))) + F.log(_bounded(2 * _tail(F.abs(z_serial)))))
    return _bounded(F.aggregate(F.array(logs), F.lit(0.0), lambda acc, x: F.exp(-x) * (1 + x + x * x / 2)))  # chi-squared of 6 degrees


def _pieces(run: Column, base: Column) -> Column:
    """What the base spans (by start) leave of a run, as (start, end, value); the value lacks a mark at a cut."""
    met = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    place = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    empty = F.filter(F.array(place(run["start"], run["end"])), lambda x: F.lit(False))

    def upto(acc, end):
        return F.when(end - acc["at"] >= LEAST_RUN, F.array_append(acc["out"], place(acc["at"], end))).otherwise(acc["out"])

    left = F.aggregate(met, state(run["start"], empty), lambda acc, b: state(F.greatest(acc["at"], b["end"]), upto(acc, b["start"])),
                       lambda acc: upto(acc, run["end"]))

    def piece(x):
        value = F.substring(run["value"], (x["start"] - run["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        value = F.when(x["start"] > run["start"], F.regexp_replace(value, f"^{MARKS}", "")).otherwise(value)
        value = F.when(x["end"] < run["end"], F.regexp_replace(value, f"{MARKS}$", "")).otherwise(value)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), value.alias("value"))

    return F.transform(left, piece)


def _found(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep`, __base spans and __candidates (start, kind, end, p)."""
    df = docs.select(*[F.col(f"`{k}`") for k in keep], whole(text).alias("__text"))
    t = F.col("__text")
    df = settled(df, keep, {
        "__assign": F.filter(_spans(t, ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= MIN_VALUE),
        "__access": F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1)).otherwise(F.filter(_spans(F.lit(""), ACCESS, 1), lambda x: F.lit(False))),
        "__hex": _spans(t, HEX, 2),
        "__runs": _spans(t, RUN, 3),
    })
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    df = df.select(*keep, "__runs", F.sort_array(F.concat(plain("__assign"), plain("__access"), plain("__hex"))).alias("__base"))
    pieces = F.flatten(F.transform("__runs", lambda x: _pieces(x, F.col("__base"))))
    df = settled(df, keep + ["__base"], {"__pieces": pieces})
    coded = F.transform("__pieces", lambda x: F.struct(x["start"], x["end"], x["value"], _encoding(x["value"]).alias("code")))
    return settled(df, keep + ["__base"], {"__candidates": F.transform(coded, lambda x: F.struct(
        x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"), randomness(x["value"], x["code"]).alias("p")))})


def _bin(c: Column) -> Column:
    """The bin of p times length: the weighted p-value but for a factor of the corpus."""
    return F.ceil(F.log2(c["p"] * (c["end"] - c["start"])) * BINS_PER_OCTAVE).cast("int")


def dismissal_bin(docs: DataFrame, text: str = "text", rate: float = FALSE_DISMISSALS) -> int:
    """The highest bin that is dismissed, by Benjamini-Hochberg over all candidates of the corpus.

    p counts as the upper edge of its bin, so rounding never dismisses more. The histogram has at
    most (log2(1 / LEAST_P) + 40) * BINS_PER_OCTAVE rows, whatever the corpus.
    """
    c = _found(docs, text, []).select(F.explode("__candidates").alias("c")).select("c.*")
    rows = c.groupBy(_bin(F.struct("start", "end", "p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 / (F.col("end") - F.col("start"))).alias("inverse")).collect()
    total, mean = sum(r.n for r in rows), sum(r.inverse for r in rows)
    best, rank = -10**9, 0
    for r in sorted(rows, key=lambda r: r.bin):
        rank += r.n
        if 2 ** (r.bin / BINS_PER_OCTAVE) * mean / total <= rate * rank / total:
            best = r.bin
    return best


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rate: float = FALSE_DISMISSALS) -> DataFrame:
    """`keep` (default doc_id) and spans array<struct<start, kind, end>> by start, then kind
    (an index into KINDS), end. Two passes over the texts, none of them shuffled."""
    keep, limit = keep or ["doc_id"], dismissal_bin(docs, text, rate)
    random = F.transform(F.filter("__candidates", lambda c: _bin(c) > limit), lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return _found(docs, text, keep).select(*keep, F.sort_array(F.concat("__base", random)).alias("spans"))


def span_list(spans: Column) -> Column:
    name = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced once; spans in order of start."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
