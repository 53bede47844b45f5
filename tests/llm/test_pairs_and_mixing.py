"""Near duplicates, mixing, tool calls: against brute force, and on odd rows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import mixing, near_dedup, tool_calls
from tests.llm.conftest import prose


def shingles(text, width):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = (text or "").encode().translate(table).split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width=4, percent=80):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        before = dict(label)
        for a in ids:
            for b in ids:
                if a < b and label[a] != label[b] and any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    old, new = max(label[a], label[b]), min(label[a], label[b])
                    label = {k: new if v == old else v for k, v in label.items()}
        if before == label:
            break
    return label


def changed(text, rng, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(8)
    rows = []
    for group in range(6):
        base = prose(100 + group, 60 + 20 * group)
        rows += [(1000 * group + k, changed(base, rng, 0.012 * (k % 4)), "a") for k in range(14)]
    rows += [(9000 + i, prose(300 + i, 1 + i), "b") for i in range(12)]
    rows += [(9100, "The Same Words", "b"), (9101, "the same  words", "b"), (9102, "É x", "b"), (9103, "é x", "b")]
    return rows


@pytest.mark.parametrize("small, heavy", [(16, False), (1, False), (1, True)])
def test_components_agree_with_brute_force(make_docs, copies, monkeypatch, small, heavy):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # pair by pair, and in blocks
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    if heavy:  # every key counts as a hot one
        monkeypatch.setattr(near_dedup, "HEAVY", 1)
        monkeypatch.setattr(near_dedup, "PAIRS_A_TASK", 2)
    want = brute_components(copies)
    assert len(set(want.values())) > 20 and Counter(want.values()).most_common(1)[0][1] > 3
    found = {r.doc_id: r for r in near_dedup.near_duplicates(make_docs(copies)).collect()}
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in found.items())
    texts = {i: t for i, t, _ in copies}
    assert all(r.n_shingles == len(shingles(texts[i], 4)) for i, r in found.items())


def test_blocks_return_a_forest_in_little_memory():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, 400).astype(np.uint64)
    sets = []
    for i in range(2048):
        s = base.copy()
        s[rng.choice(400, 12, replace=False)] = rng.integers(0, 2**62, 12)
        sets.append(np.unique(s))
    labels = np.arange(2048)
    tracemalloc.start()
    found = near_dedup.block_links(sets[:1024], sets[1024:], labels, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1024 <= len(found) <= 2047 and peak < 120e6
    assert all(a < 1024 <= b for a, b in found)
    assert len({x for link in found for x in link}) == 2048  # all of them are joined

    far = [np.unique(rng.integers(0, 2**62, 50).astype(np.uint64)) for _ in range(40)]
    assert near_dedup.block_links(far[:20], far[20:], np.arange(40), 80) == []
    same = [far[0]] * 10
    assert near_dedup.block_links(same, same, np.zeros(20, int), 80) == []
    assert len(near_dedup.block_links(same, same, np.r_[np.zeros(10, int), np.ones(10, int)], 80)) == 1
    for n, k in ((100, 88), (100, 89), (50, 44), (50, 45)):  # on either side of the threshold
        a = np.arange(n).astype(np.uint64)
        b = np.r_[a[:k], np.arange(1000, 1000 + n - k).astype(np.uint64)]
        assert len(near_dedup.block_links([a], [b], np.arange(2), 80)) == (100 * k >= 80 * (2 * n - k))


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 1), (2, "a b c d e f", 6, 2)], "doc_id long, text string, __gone long, component_id long")
    assert near_dedup.deduplicated(docs).columns == docs.columns and near_dedup.deduplicated(docs).count() == 1


def test_odd_rows_and_deduplication(make_docs, odd_rows):
    found = near_dedup.near_duplicates(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    rows = {r.doc_id: r for r in found}
    assert rows[1].n_shingles == rows[2].n_shingles == 0 and rows[1].component_id == 1 and rows[2].kept
    assert rows[None].component_id is None and rows[5].component_id == 5
    assert near_dedup.near_duplicates(make_docs([]).limit(0)).count() == 0
    docs = make_docs([(1, prose(1, 50), "a"), (2, prose(1, 50), "b"), (3, prose(2, 50), "b"), (None, prose(1, 50), "b")])
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3]


def test_sketch_estimates_and_full_registers():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for n, shared in ((2000, 1600), (300, 270), (10, 9), (1, 1)):
        a, b = pool[:n], np.concatenate([pool[:shared], pool[2500 : 2500 + n - shared]])
        rows = near_dedup.sketches([a, b])
        assert (rows >= 0).all()
        want = shared / (2 * n - shared)
        got = near_dedup.estimated(rows[:1], rows[1:], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(got - want) < 0.17
    assert near_dedup.collision_rate(np.array([5.0]), np.array([5.0]))[0] < 0.01


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(df).collect()}
    assert all(got[i] == 0 for i in [*range(41), 300]) and all(got[100 + i] == 100 for i in range(30))
    assert near_dedup.components(df.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------------


def test_mix_reaches_the_target_weights(make_docs):
    rows = [(i, prose(i, 20), "big") for i in range(1500)] + [(5000 + i, prose(i, 20), "small") for i in range(300)] + [(9000, "one", None)]
    mixed = mixing.mix_sources(make_docs(rows), {"big": 1, "small": 3}, epochs=2.0)
    got = mixed.collect()
    mass = Counter()
    for r in got:
        mass[r.source] += len(r.text) + 1
    assert set(mass) == {"big", "small"} and abs(mass["small"] / sum(mass.values()) - 0.75) < 0.04
    counts = Counter(r.doc_id for r in got)
    assert all(counts[r.doc_id] == r.copies and 1 <= r.copy <= r.copies for r in got)
    assert len({r.shuffle_key for r in got}) == len(got)
    again = mixing.mix_sources(make_docs(rows[::-1]), {"big": 1, "small": 3}, epochs=2.0)
    assert sorted((r.doc_id, r.copy) for r in again.collect()) == sorted((r.doc_id, r.copy) for r in got)


def test_draws_follow_the_poisson_distribution(spark):
    from pyspark.sql import functions as F

    for rate in (0.3, 2.0, 90.0):
        table = mixing.with_inversion(spark.createDataFrame([(rate,)], "rate double"))
        drawn = spark.range(4000).join(F.broadcast(table)).select(mixing.copies_drawn(F.col("id"), 3).alias("n")).toPandas()["n"]
        assert abs(drawn.mean() - rate) < 4 * (rate / 4000) ** 0.5 and abs(drawn.var() / rate - 1) < 0.12


def test_mix_odd_rows_and_many_sources(make_docs, odd_rows, monkeypatch):
    docs = make_docs(odd_rows)
    got = mixing.mix_sources(docs, epochs=30.0)
    assert got.columns == [c for c in docs.columns if c != "copy"] + mixing.ADDED
    rows = got.collect()
    assert {r.source for r in rows} <= {"a", "b", None} and None in {r.doc_id for r in rows}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)  # the salted join
    again = mixing.mix_sources(docs, epochs=30.0).collect()
    assert sorted(r.shuffle_key for r in rows) == sorted(r.shuffle_key for r in again)
    assert mixing.mix_sources(make_docs([]).limit(0)).count() == 0


# --- tool calls ------------------------------------------------------------------------------


def test_linking_levels_and_validation(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "reply", '{"turn":1.5,"prompt":"x","zz":1}', None), (1, 0, "a", "reply", '{"turn":1.5,"prompt":"x","zz":1}', None),
        (1, 1, "a", "reply", "{}", None), (1, 2, "b", "reply", '{"turn":3,"prompt":""}', "a"), (1, 3, "x", "reply", '{"turn":3}', "y"),
        (1, 4, "y", "other", "[1]", "x"), (1, 5, "z", "other", '{"b":1,"a":{"d":2,"c":[1,2.50,true,null]}}', "q"),
        (1, 6, None, "reply", None, None), (1, 7, "w", "reply", "bad", "w"), (None, 8, "v", "reply", "{}", None), (2, 0, "a", "reply", '{"prompt":"é","turn":0}', None),
    ], "conv_id long, turn long, call_id string, tool string, arguments string, after string")
    results = spark.createDataFrame([(1, 1, "a", "res"), (1, 9, "a", "res2"), (1, 9, "nope", "é\n"), (1, 9, None, "lost")],
                                    "conv_id long, turn long, call_id string, content string")
    rows = tool_calls.link_tool_calls(calls, results, tool_calls.REPLY).collect()
    assert len(rows) == 11 + 2
    at = {(r.conv_id, r.call_id, r.status): r for r in rows}
    assert Counter(r.status for r in rows) == {"linked": 1, "no_result": 6, "orphan_result": 1, "duplicate_call": 2, "no_id": 3}
    linked = at[1, "a", "linked"]
    assert (linked.n_results, linked.result_turn, linked.errors) == (2, 1, ["type:turn", "unknown:zz"])
    assert linked.json == '{"arguments":{"prompt":"x","turn":1.5,"zz":1},"id":"a","name":"reply","result":"res"}'
    assert at[1, "b", "no_result"].level == 1 and at[1, "b", "no_result"].errors == ["range:prompt"]
    assert at[1, "x", "no_result"].level is None and "cycle" in at[1, "y", "no_result"].errors
    assert at[1, "z", "no_result"].json.startswith('{"arguments":{"a":{"c":[1,2.5,true,null],"d":2},"b":1}')
    assert at[1, "w", "no_result"].errors == ["not_an_object", "unknown_after"] and at[2, "a", "no_result"].errors == []
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), tool_calls.REPLY).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    real = tool_calls.materialize
    monkeypatch.setattr(tool_calls, "materialize", lambda df, name: made.append(name) or real(df, name))
    order = list(range(300))
    random.Random(1).shuffle(order)
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None) for i in order]
    got = {r.call_id: r.level for r in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()}
    assert got == {f"c{i}": i for i in range(300)} and len(made) <= 11


def test_every_turn_has_a_row(spark):
    long_text = prose(9, 20_000)
    turns = [(1, 0, "system", "be kind", 1), (1, 1, "user", "hi", 1), (1, 2, "assistant", "yes", 1), (1, 3, None, None, 1), (1, 4, "tool", "", 1),
             (2, 0, "user", None, 1), (2, None, "user", "lost", 1), (None, 1, "assistant", "lost too", 1), (3, 0, "user", long_text, 1), (3, 1, "assistant", "", 1)]
    made = tool_calls.linked_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, status int").repartition(3))
    got = {(r.conv_id, r.turn): r for r in made.collect()}
    assert {k: r.status for k, r in got.items()} == {
        (1, 0): "other_turn", (1, 1): "linked", (1, 3): "other_turn", (1, 4): "other_turn", (2, 0): "no_result", (2, None): "no_id", (None, 1): "no_id", (3, 0): "linked"}
    assert got[(1, 0)].json == '{"content":"be kind","role":"system"}' and got[(1, 3)].json == '{"content":null,"role":null}'
    assert long_text in got[(3, 0)].json and got[(2, 0)].errors == ["missing:prompt"]
    assert tool_calls.linked_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rows_without_an_id_are_drawn_and_placed_apart(spark):
    rows = [(None, f"text {i}", "a") for i in range(1000)] + [(7, f"text {i}", "a") for i in range(1000)] + [(i, "same", "b") for i in range(1000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for group in ([r for r in got if r.doc_id is None], [r for r in got if r.doc_id == 7], [r for r in got if r.source == "b"]):
        assert len({r.shuffle_key for r in group}) == len(group) and len({r.copies for r in group}) > 2
