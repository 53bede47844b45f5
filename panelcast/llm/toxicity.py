r"""Toxicity by a weighted finite-state grammar of clauses.

A lexical transducer turns words into classes (insult, threatening verb, intent, target, negation, report) with
weights. Five small sequential transducers are composed into one table that reads the classes of a clause:

* reported speech: what follows a verb of saying up to the end of the clause, or stands in quotes, is reported;
* negation: the next SCOPE words after a negation are negated;
* target: an insult or threat up to SCOPE words after a person or `you` is directed;
* threat: intent, then a threatening verb, then a target, each within SCOPE words of the one before;
* insult: an insult gives a match; a target up to SCOPE words later directs it in hindsight.

So single words never score by themselves; matches do, by their kind: plain, directed, negated or reported insult,
threat, negated or reported threat. A clause adds the weights of its matches to the kinds' sums; the logarithms
of the sums enter a logistic model.

Learning. The lexicon starts from the fixed words below. Further insults are words and stems (the first 3 to 7
letters) that occur in toxic texts far more often than chance allows, under false-discovery control. Support is counted in
different contexts (the neighbouring words), so that copies of a text count once. Weights are log odds. The logistic
model shrinks towards PRIOR. Lexicon and model are learnt from at most MAX_ROWS labelled texts, those
with the smallest hashes of their id, and at most MAX_PATTERNS candidate patterns reach the driver; both bounds are parameters.
Everything is scored, over whole texts.

Defined results: null and empty texts match nothing and get the score of a text without matches; rows with a null label or id
are not learnt from; repeated rows are learnt from once for each label, and all scored; without labelled rows, or with labels of one
kind only, the fixed lexicon and the prior are used; extra columns are dropped unless named in `keep`; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from typing import Callable, Iterable, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import map_texts, smallest_hashes, whole

# Words of each class.
INSULTS = """idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting clown imbecile dumbass
bastard vermin dummkopf trottel abschaum arschloch idiota imbécil estúpido estúpida escoria crétin imbécile ordure débile""".split()
THREATS = "kill hurt destroy beat burn hang shoot stab strangle crush töten umbringen schlagen matar golpear quemar tuer frapper brûler".split()
INTENTS = "will gonna going should must shall hope 'll werde werden soll voy vamos debería vais allons devrait".split()
TARGETS = "you your yours yourself they them their he him she her people everyone du dich dir euch ihr tú ti usted ustedes tu toi te vous".split()
NEGATIONS = "not never no nobody cannot without nicht kein keine nie nunca jamás pas jamais sin sans".split()
REPORTS = """said says say wrote writes called calls claimed claims quoted quotes reported reports told shouted sagte schrieb nannte
dijo escribió llamó dit écrit appelé""".split()

SCOPE = 3
MAX_ROWS, MAX_PATTERNS = 20_000, 20_000
STEMS = (3, 4, 5, 6, 7)
CLOSE = 0.9
LEAST_SUPPORT, FALSE_SHARE = 3, 0.02
KINDS = ("plain", "directed", "negated", "reported", "threat", "unmeant threat")
PRIOR = np.array([-3.0, 3.0, 3.5, 1.0, 0.7, 3.5, 0.7])  # intercept, then the kinds
SHRINK = 1.0
FIXED_WEIGHT = 4.0
CACHE_WORDS = 300_000

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

# --- transducers -------------------------------------------------------------------------------

# A symbol is a class letter with flags: i insult, h threatening verb, v intent, t target, n negation, r report,
# w other word, q quote, c end of clause, e end of line; flags ~ negated, " reported, > directed.
CLASSES = "ihvtnrwqce"


class Transducer(NamedTuple):
    """A sequential letter transducer: arcs[state][symbol] = (next state, output)."""

    start: int
    arcs: list[dict[str, tuple[int, str]]]

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.arcs[state][s]
            out.append(o)
        return out


def explored(start, symbols: Iterable[str], step: Callable) -> Transducer:
    """The transducer of the states that can be reached by step(state, symbol) = (state, output)."""
    symbols = list(symbols)
    number, arcs, queue = {start: 0}, [], [start]
    while queue:
        state = queue.pop(0)
        row = {}
        for s in symbols:
            after, out = step(state, s)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row[s] = (number[after], out)
        arcs.append(row)
    return Transducer(0, arcs)


def outputs(t: Transducer) -> list[str]:
    return sorted({o for row in t.arcs for _, o in row.values()})


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What a does, then b to its output."""

    def step(state, symbol):
        p, middle = a.arcs[state[0]][symbol]
        q, out = b.arcs[state[1]][middle]
        return (p, q), out

    return explored((a.start, b.start), a.arcs[0], step)


def reported(symbols) -> Transducer:
    def step(state, s):  # state: said in this clause, in quotes
        said, quoted = state
        if s == "q":
            return (said, not quoted), s
        if s in "ce":
            return (False, quoted and s == "c"), s
        marked = s + '"' if s in "ih" and (said or quoted) else s
        return (said or s == "r", quoted), marked

    return explored((False, False), symbols, step)


def negation(symbols) -> Transducer:
    def step(left, s):
        if s in "ce":
            return 0, s
        if s == "n":
            return SCOPE, s
        return max(left - 1, 0), s + "~" if left and s[0] in "ih" else s

    return explored(0, symbols, step)


def target(symbols) -> Transducer:
    def step(left, s):
        if s in "ce":
            return 0, s
        if s == "t":
            return SCOPE, s
        return max(left - 1, 0), s + ">" if left and s[0] == "i" else s

    return explored(0, symbols, step)


def threat(symbols) -> Transducer:
    def step(state, s):  # state: what is awaited, words left, flags of the verb
        awaited, left, flags = state
        if s in "ce":
            return ("", 0, ""), s
        if s == "v":
            return ("verb", SCOPE, ""), s
        if s[0] == "h":
            return (("target", SCOPE, s[1:]) if awaited == "verb" and left else ("", 0, "")), "w"
        if s == "t" and awaited == "target" and left:
            return ("", 0, ""), "T" + flags
        return ((awaited, left - 1, flags) if left > 1 else ("", 0, "")), s

    return explored(("", 0, ""), symbols, step)


def insult(symbols) -> Transducer:
    def step(left, s):
        if s in "ce":
            return 0, s
        if s[0] == "i":
            return (0 if ">" in s else SCOPE), "I" + s[1:]
        if s == "t" and left:
            return 0, "D"  # the last insult is directed after all
        return max(left - 1, 0), s if s[0] == "T" else "w"

    return explored(0, symbols, step)


def grammar() -> Transducer:
    made = reported(CLASSES)
    for machine in (negation, target, threat, insult):
        made = compose(made, machine(outputs(made)))
    return made


def kind_of(match: str) -> int:
    """The place in KINDS of an output that begins with I or T."""
    unmeant = 3 if '"' in match else 2 if "~" in match else None
    if match[0] == "T":
        return 4 if unmeant is None else 5
    return unmeant if unmeant is not None else 1 if ">" in match else 0


# --- lexicon and matches -----------------------------------------------------------------------


class Lexicon(dict):
    """The lexical transducer: a word's class and weight, the longest stem if the word itself is unknown.

    Words already met are kept, CACHE_WORDS at most.
    """

    def __init__(self, words: dict[str, float] | None = None, stems: dict[str, float] | None = None):
        super().__init__()
        self.words, self.stems = words or {}, stems or {}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.fixed = {}
        for letter, names in (("h", THREATS), ("v", INTENTS), ("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS)):
            self.fixed.update((w, (letter, 0.0)) for w in names)
        for mark in "\"“”„«»":
            self.fixed[mark] = ("q", 0.0)
        for mark in ".!?;:":
            self.fixed[mark] = ("c", 0.0)
        self.fixed["\n"] = ("e", 0.0)

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def __missing__(self, word: str) -> tuple[str, float]:
        found = self.fixed.get(word)
        if word in self.words:
            found = ("i", self.words[word])
        elif found is None and word.endswith(("n't", "n’t")):
            found = ("n", 0.0)
        elif found is None and word.endswith(("'ll", "’ll")):
            found = ("v", 0.0)
        elif found is None:
            stem = next((word[:n] for n in self.lengths if word[:n] in self.stems), None)
            found = ("w", 0.0) if stem is None else ("i", self.stems[stem])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


_GRAMMAR = grammar()


def matches(text: str, lexicon: Lexicon) -> np.ndarray:
    """For each kind the weights of its matches, summed over the clauses of a text."""
    sums = np.zeros(len(KINDS))
    found = [lexicon[w] for w in _TOKEN.findall(text.lower())]
    if not any(c in "ih" for c, _ in found):
        return sums
    state, arcs, last = _GRAMMAR.start, _GRAMMAR.arcs, None
    for letter, weight in found:
        state, out = arcs[state][letter]
        if out[0] == "I":
            last = (kind_of(out), weight)
            sums[last[0]] += weight
        elif out[0] == "T":
            sums[kind_of(out)] += FIXED_WEIGHT
        elif out == "D" and last and last[0] == 0:
            sums[0] -= last[1]
            sums[1] += last[1]
            last = None
    return np.maximum(sums, 0.0)


# --- learning ----------------------------------------------------------------------------------


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, sums: np.ndarray) -> np.ndarray:
        z = self.weights[0] + np.log1p(sums) @ self.weights[1:]
        return 1 / (1 + np.exp(-z))


def patterns(words: list[str]) -> dict[str, set[int]]:
    """Words and stems (marked by a star) of a text, each with hashes of the contexts they stand in."""
    found: dict[str, set[int]] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        context = xxhash.xxh3_64_intdigest(f"{before} {word} {after}") >> 1
        found.setdefault(word, set()).add(context)
        for n in STEMS:
            if n < len(word):
                found.setdefault(word[:n] + "*", set()).add(context)
    return found


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def tail(k: int, n: int, share: float) -> float:
    """The chance of k or more successes in n trials."""
    if k <= n * share:
        return 1.0
    total, term = 0.0, math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
    for i in range(k, n + 1):
        total += term
        term *= (n - i) / (i + 1) * share / (1 - share)
        if term < total * 1e-12:
            break
    return total


def chosen(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems to learn, with log odds, from counts of (toxic support, clean texts).

    Benjamini-Hochberg over all candidates; then, from short to long, a pattern that a chosen stem covers is left out,
    and one that owes its support to a longer pattern (CLOSE of it or more) gives way to that.
    """
    share = toxic / (toxic + clean)
    tested = sorted((tail(a, a + b, share), p) for p, (a, b) in counts.items() if a >= LEAST_SUPPORT)
    passing = [i for i, (p, _) in enumerate(tested) if p <= FALSE_SHARE * (i + 1) / len(tested)]
    odds = lambda a, b: math.log((a + 0.5) / (b + 0.5) * (clean + 1) / (toxic + 1))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    kept = {p for _, p in tested[: passing[-1] + 1]} if passing else set()
    kept = sorted((p for p in kept if counts[p][0] >= 9 * counts[p][1]), key=lambda p: (p.rstrip("*"), p))  # no mixed evidence
    for p in sorted(kept, key=lambda p: (len(p.rstrip("*")), p)):
        plain = p.rstrip("*")
        if any(plain[:n] in stems for n in STEMS if n <= len(plain)) or plain in words:
            continue
        within = kept[bisect_left(kept, plain, key=lambda q: q.rstrip("*")) : bisect_right(kept, plain + "\U0010ffff", key=lambda q: q.rstrip("*"))]
        best = max((q for q in within if p.endswith("*") and counts[q][0] >= CLOSE * counts[p][0]), default=p, key=lambda q: (len(q.rstrip("*")), -len(q)))
        (stems if best.endswith("*") else words)[best.rstrip("*")] = max(odds(*counts[best]), 0.5)
    for w in INSULTS:
        a, b = counts.get(w, (0, 0))
        words[w] = max(math.log((a + 4.0) / (b + 0.5) * (clean + 1) / (toxic + 1)), 0.0) if a + b else FIXED_WEIGHT
    return words, stems


def logistic(sums: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the kinds, shrunk towards PRIOR, by Newton's method."""
    x = np.c_[np.ones(len(y)), np.log1p(sums)]
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (y - p) - SHRINK * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + SHRINK * np.eye(len(w)), gradient)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_on(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id: str = "doc_id",
    max_rows: int = MAX_ROWS, max_patterns: int = MAX_PATTERNS,
) -> Model:
    """labels: id and label 0 or 1. The sample is taken before any text is read."""
    marked = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y")).filter("__y IS NOT NULL AND __id IS NOT NULL")
    sample = F.broadcast(smallest_hashes(marked.distinct(), "__id", max_rows).drop("__hash"))  # at most max_rows ids and labels
    rows = docs.select(F.col(f"`{id}`").alias("__id"), whole(f"`{text}`").alias("__t")).join(sample, "__id")
    # Equal texts with equal labels are learnt from once, whatever their ids.
    rows = rows.groupBy(F.sha2("__t", 256).alias("__h"), "__y").agg(F.first("__t").alias("__t")).persist()
    try:
        return _fit(smallest_hashes(rows, ["__h", "__y"], max_rows).select("__t", "__y"), max_patterns)  # an id may stand for many texts
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, max_patterns: int) -> Model:
    sizes = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(Lexicon(*chosen({}, 1, 1)), PRIOR)

    def spelled(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = patterns(words_of(t))
                yield pa.RecordBatch.from_pydict({
                    "pattern": pa.array([p for p, c in found.items() for _ in c], pa.string()),
                    "context": pa.array([h for c in found.values() for h in c], pa.int64())})

    contexts = rows.filter("__y = 1").select("__t").mapInArrow(spelled, "pattern string, context bigint")
    support = contexts.groupBy("pattern").agg(F.count_distinct("context").alias("n")).filter(F.col("n") >= LEAST_SUPPORT)
    toxic_counts = {r["pattern"]: r["n"] for r in support.orderBy(F.desc("n"), "pattern").limit(max_patterns).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(set(toxic_counts) | set(INSULTS))

    def counted(batches):
        wanted, held = shared.value, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = set(words_of(t))
                held.update((words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}) & wanted)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    sums = rows.filter("__y = 0").select("__t").mapInArrow(counted, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    clean_counts = {r["pattern"]: r["n"] for r in sums.collect()}  # at most max_patterns and the fixed words
    counts = {p: (toxic_counts.get(p, 0), clean_counts.get(p, 0)) for p in set(toxic_counts) | set(clean_counts)}
    lexicon = Lexicon(*chosen(counts, toxic, clean))
    learnt = matched(rows, lexicon, "__t", ["__y"]).toPandas().sort_values(["__y", *_COLUMNS])
    return Model(lexicon, logistic(learnt[_COLUMNS].to_numpy(), learnt["__y"].to_numpy().astype(float)))


# --- scoring -----------------------------------------------------------------------------------

_COLUMNS = [k.replace(" ", "_") for k in KINDS]


def matched(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, and the summed weights of each kind of match."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(texts: list[bytes]) -> list:
        sums = np.array([matches(t.decode(), held.value) for t in texts]).reshape(-1, len(KINDS))
        return [pa.array(c) for c in sums.T]

    return map_texts(docs, text, keep or [], ", ".join(f"{c} double" for c in _COLUMNS), work)


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """keep (the id by default), the sums of the kinds, score."""
    z = F.lit(float(model.weights[0]))
    for c, w in zip(_COLUMNS, model.weights[1:]):
        z = z + F.log1p(c) * F.lit(float(w))
    rows = matched(docs, model.lexicon, text, [id] if keep is None else keep)
    return rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
