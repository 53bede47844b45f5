"""Fill-in-the-middle: the learned index against plain search, outputs against a plain version, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from panelcast.llm import fill_in_middle as fim
from tests.llm.conftest import prose

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\t\n\x0b\x1c 🙂", max_size=200))
def test_boundaries(text):
    assert fim.boundaries(text).tolist() == [0, *np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()]


@pytest.mark.parametrize("bound", [1, 48, 126])
def test_index_is_exact_and_within_its_bound(bound):
    rng = np.random.default_rng(3)
    for gaps in (rng.integers(1, 12, 5000), np.r_[np.full(300, 2), 90_000, np.full(300, 40)], np.array([7]), rng.geometric(0.01, 3000)):
        offsets = np.r_[0, np.cumsum(gaps)]
        index, ranks = fim.fit_index(offsets, bound), np.arange(len(offsets))
        assert (index.offsets(ranks) == offsets).all() and np.abs(offsets - index.predicted(ranks)).max() <= bound + 1
        assert len(index.starts) <= len(offsets)
    straight = fim.fit_index(np.arange(0, 50_000, 5), bound)
    assert len(straight.starts) == 1


def test_outputs_and_round_trip(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, prose(i, 1 + i * 7 % 90) + (" \n" if i % 4 == 0 else ""), "a") for i in range(150)]
    rows += [(400 + i, f"a {m} b", "a") for i, m in enumerate(["<P>", "<S>", "<M>"] * 6)] + [(500 + i, "<<P <S <M> >"[:9] + "<", "a") for i in range(20)]
    made = fim.fill_in_middle(make_docs(rows))
    got = made.withColumn("back", fim.restored()).collect()
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append((*plain_version(i, t), t or ""))
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) in want[r.doc_id]
    assert fim.fill_in_middle(make_docs([]).limit(0)).count() == 0
    kept = fim.fill_in_middle(make_docs(rows[:3]), keep=["doc_id", "n_words", "lang"])
    assert kept.columns[:3] == ["doc_id", "n_words", "lang"] and kept.count() == 3


def test_stored_index(spark, make_docs, odd_rows):
    stored = fim.rank_index(make_docs(odd_rows)).collect()
    texts = {}
    for i, t, _ in odd_rows:
        texts[i] = t or ""
    for r in stored:
        index = fim.RankIndex(*(np.array([s[k] for s in r.segments]) for k in ("start", "base", "slope")), np.frombuffer(r.residuals, np.int8))
        assert index.offsets(np.arange(r.n + 1)).tolist() == fim.boundaries(texts[r.doc_id]).tolist()
    with pytest.raises(ValueError):
        fim.rank_index(make_docs(odd_rows), bound=200)
