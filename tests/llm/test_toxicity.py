"""Toxicity: the composed grammar against plain rules, what is learnt, held-out accuracy, odd rows."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelcast.llm import toxicity as tx
from tests.llm.conftest import prose

LEXICON = tx.Lexicon({"idiot": 2.0, "scum": 3.0}, {"grumb": 1.5})


def plain_matches(text):
    """The rules word by word: clauses are split first, then every insult looks back and ahead in its own clause."""
    tokens = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n\"“”„«»]", text.lower())
    sums, clause, quoted = dict.fromkeys(tx.KINDS, 0.0), [], False
    marks = {c for c in "\"“”„«»"}
    for t in [*tokens, "\n"]:
        if t in marks:
            quoted = not quoted
            clause.append((t, "mark", quoted))
        elif t in ".!?;:\n":
            read_clause(clause, sums)
            clause, quoted = [], quoted and t != "\n"
        else:
            clause.append((t, LEXICON[t][0], quoted))
    return [sums[k] for k in tx.KINDS]


def read_clause(clause, sums):
    near = lambda i, kind: any(clause[j][1] == kind for j in range(max(i - tx.SCOPE, 0), i))
    open_insult = None  # place, weight and kind of an insult that still may be directed
    intent = verb = None
    for i, (word, kind, quoted) in enumerate(clause):
        told = quoted or any(k == "r" for _, k, _ in clause[:i])
        if kind == "i":
            negated = last_negation(clause, i)
            name = "reported" if told else "negated" if negated else "directed" if near(i, "t") else "plain"
            sums[name] += LEXICON[word][1]
            open_insult = None if near(i, "t") else (i, LEXICON[word][1], name)
        if kind == "t":
            if verb is not None and i - verb[0] <= tx.SCOPE:
                sums["unmeant threat" if verb[1] else "threat"] += tx.FIXED_WEIGHT
            elif open_insult and i - open_insult[0] <= tx.SCOPE:
                if open_insult[2] == "plain":
                    sums["plain"] -= open_insult[1]
                    sums["directed"] += open_insult[1]
                open_insult = None
            verb = None if verb is not None and i - verb[0] <= tx.SCOPE else verb
        if kind == "v":
            intent, verb = i, None
        if kind == "h":
            meant = intent is not None and i - intent <= tx.SCOPE and verb is None
            verb = (i, told or last_negation(clause, i)) if meant else None
            intent = None


def last_negation(clause, i):
    return any(clause[j][1] == "n" for j in range(max(i - tx.SCOPE, 0), i))


WORDS = ["idiot", "scum", "grumbly", "kill", "will", "you", "not", "don't", "said", '"', "tree", "river", ".", "\n", "she"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=25))
def test_grammar_against_plain_rules(words):
    text = " ".join(words)
    assert tx.matches(text, LEXICON).tolist() == pytest.approx(plain_matches(text))


@pytest.mark.parametrize("text, kind", [
    ("what an idiot", "plain"), ("you are an idiot", "directed"), ("idiots like you, scum like them", "directed"),
    ("he is not an idiot", "negated"), ("they said idiot", "reported"), ('it reads "idiot" here', "reported"),
    ("i will kill you", "threat"), ("i will not kill you", "unmeant threat"), ("she said we will kill you", "unmeant threat"),
])
def test_kinds(text, kind):
    sums = dict(zip(tx.KINDS, tx.matches(text, LEXICON)))
    assert max(sums, key=sums.get) == kind and sums[kind] > 0


def test_words_alone_or_apart_do_not_match():
    assert tx.matches("kill the process. you will see", LEXICON).sum() == 0
    assert tx.matches("you will. kill it", LEXICON).sum() == 0
    assert tx.matches("idiotic scumbag", LEXICON).sum() == 0  # whole words, not parts
    assert tx.matches("grumble grumbs", LEXICON)[0] == 3.0


def test_composition_equals_the_cascade():
    made, rng = tx.grammar(), random.Random(2)
    for _ in range(200):
        symbols = [rng.choice(tx.CLASSES) for _ in range(30)]
        stepwise, machine = symbols, tx.reported(tx.CLASSES)
        stepwise = machine.run(stepwise)
        for build in (tx.negation, tx.target, tx.threat, tx.insult):
            machine = build(sorted(set(stepwise) | set(tx.CLASSES)))
            stepwise = machine.run(stepwise)
        assert made.run(symbols) == stepwise


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    """Toxic texts hold fixed insults, or invented words of one stem; two large groups of copies, toxic and clean."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(900):
        words = prose(i, rng.randrange(15, 90)).split()
        toxic = i % 6 == 0
        if toxic:
            insult = (lambda: rng.choice(["moron", "trash"])) if i % 12 else (lambda: "vorquel" + rng.choice("abcdefghij") + rng.choice("xyz"))
            for _ in range(3):
                words.insert(rng.randrange(len(words)), insult())
        rows.append((i, " ".join(words) + ".", "a"))
        labels.append((i, int(toxic)))
    copies = prose(5000, 60) + " moron kestrel"
    rows += [(2000 + i, copies, "a") for i in range(300)] + [(3000 + i, prose(6000, 60), "a") for i in range(300)]
    labels += [(2000 + i, 1) for i in range(300)] + [(3000 + i, 0) for i in range(300)]
    odd = [(5, None), (None, 1), (10**6, 1)]
    return make_docs(rows), spark.createDataFrame(labels + odd, "doc_id long, toxic int")


def test_held_out_accuracy_and_what_is_learnt(labelled):
    docs, labels = labelled
    model = tx.fit_on(docs, labels.filter("doc_id % 3 <> 1 OR doc_id >= 2000"))
    assert "vorquel" in model.lexicon.stems and "kestrel" not in model.lexicon.words
    scored = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    assert all((scored[i] >= 0.7) == (i % 6 == 0) for i in range(900)) and len(held) == 300
    assert all(0 <= s <= 1 for s in scored.values())


def test_degenerate_labels_bounds_and_odd_rows(spark, make_docs, odd_rows, labelled):
    docs, labels = labelled
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        model = tx.fit_on(docs, few)
        assert (model.weights == tx.PRIOR).all() and model.lexicon.words["idiot"] == tx.FIXED_WEIGHT
    model = tx.fit_on(docs, labels, max_rows=200)
    rows = odd_rows + [(50, "you idiot " * 30_000, "a"), (51, "you idiot", "a")]
    got = tx.score(make_docs(rows), model, keep=["doc_id", "n_words"]).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and None not in [r.score for r in got]
    assert scores[1] == scores[2] == scores[6] < 0.5 and scores[50] > 0.9 and scores[51] > 0.7
    assert tx.score(make_docs([]).limit(0), model).count() == 0


def test_false_discoveries():
    rng = np.random.default_rng(3)
    counts = {f"w{i}": (int(a), int(b)) for i, (a, b) in enumerate(zip(rng.binomial(30, 0.1, 20_000), rng.binomial(30, 0.9, 20_000)))}
    words, stems = tx.chosen(counts, 200, 1800)
    assert not stems and set(words) == set(tx.INSULTS)
    assert tx.tail(3, 3, 0.1) == pytest.approx(0.001) and tx.tail(0, 5, 0.1) == 1.0
    assert tx.tail(4, 10, 0.2) == pytest.approx(0.12087388160, abs=1e-9)
