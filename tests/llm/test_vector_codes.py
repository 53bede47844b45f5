"""Vector codes: metric trees and whole rounds against a plain k-means, ties, equal entries, odd rows."""

import hashlib

import numpy as np
import pytest

from panelcast.llm import vector_codes as vc


def nearest(points, book):
    return ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)


@pytest.mark.parametrize("n, spread, width", [(1, 5, 4), (49, 2, 3), (700, 1, 4), (2048, 30, 4), (600, 400, 1), (900, 0, 2)])
def test_trees_own_what_the_nearest_entry_takes(n, spread, width):
    rng = np.random.default_rng(n)
    points = np.floor(rng.normal(0, 1, (n, width)) * spread).astype(np.int64)
    points[: n // 3] = points[0]  # one vector in many copies
    tree = vc.grow(points)
    assert sorted(tree.items.tolist()) == list(range(n))
    for i in range(len(tree.radius)):  # what a ball caches
        inside = points[tree.items[tree.first[i] : tree.first[i] + tree.number[i]]]
        assert (inside.sum(0) == tree.total[i]).all()
        assert np.sqrt(((inside - tree.center[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
    for book in (points[:64], points[rng.integers(0, n, 64)], np.zeros((64, width), np.int64), np.floor(rng.normal(0, 3, (64, width))).astype(np.int64) * 9):
        want = nearest(points, book)
        assert (vc.assigned(tree, points, book) == want).all()
        count, total = vc.totals(tree, points, book)
        assert (count == np.bincount(want, minlength=len(book))).all()
        assert all((total[e] == points[want == e].sum(0)).all() for e in range(len(book)))


def test_balls_are_wholly_owned():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, (20, 4))
    points = middles[rng.integers(0, 20, 2000)] + rng.integers(-3, 4, (2000, 4))
    tree = vc.grow(points)
    alone = sum((w < 0).sum() for w, _ in vc.owners(tree, points, middles))
    assert alone == 0  # no point was compared by itself


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, read plainly."""
    kept = [(i, e) for i, e, *_ in rows if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(256 * np.array([e for _, e in kept], np.float64)).astype(np.int64)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % parts)))
    width = v.shape[1] // parts
    pieces = [v[:, p * width : (p + 1) * width] for p in range(parts)]
    books = [piece[:entries].copy() for piece in pieces]
    for _ in range(rounds):
        for piece, book in zip(pieces, books):
            own = nearest(piece, book)
            for e in np.unique(own):
                book[e] = piece[own == e].sum(0) // (own == e).sum()
    codes = np.stack([nearest(piece, book) for piece, book in zip(pieces, books)], 1)
    errors = sum(((piece - book[code]) ** 2).sum(1) for piece, book, code in zip(pieces, books, codes.T))
    return sorted(((r[0] is None, r[0] or 0), c, int(e)) for r, c, e in zip(kept, codes.tolist(), errors)), books


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(0, 0.4, 32).round(3).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(5000)]
    rows += [(9000 + i, rows[0][1], 1) for i in range(2600)]  # a third of the rows are one vector
    rows += [(9000, rows[0][1], 1), (None, rows[3][1], 2), (None, rows[4][1], 2)]
    bad = [(20_000, None, 1), (20_001, [], 1), (20_002, [0.1] * 31 + [None], 1), (20_003, [float("nan")] * 32, 1), (20_004, [float("inf")] + [0.0] * 31, 1)]
    unlike = [(20_005, [0.5] * 16, 1), (20_006, [1e30] + [0.0] * 31, None)]
    kind = "vec_id long, embedding array<double>, label int, code string, error int, __k int"
    make = lambda r: spark.createDataFrame([(*x, "c", 1, 2) for x in r], kind).repartition(5)
    return make, rows, bad, unlike


def test_whole_rounds_with_odd_rows(vectors):
    make, rows, bad, unlike = vectors
    coded, books = vc.compress(make(rows + bad + unlike), keep=["label"])
    got = coded.collect()
    assert {r.vec_id for r in got if r.code is None} == {20_005, 20_006} and len(got) == len(rows) + 2
    want, wanted_books = brute(rows)
    assert all((a == b).all() for a, b in zip(books, wanted_books))
    assert sorted(((r.vec_id is None, r.vec_id or 0), list(r.code), r.error) for r in got if r.code is not None) == want
    digest = hashlib.sha256(",".join(str(c) for b in wanted_books for e in b.tolist() for c in e).encode()).hexdigest()
    assert vc.codebook_digest(books) == digest


def test_few_rows_filled_up_lengths_and_empty_tables(vectors, spark):
    make, rows, bad, _ = vectors
    short = [(i, e[:19], l) for i, e, l in rows[:9]]
    coded, books = vc.compress(make(short))
    assert sorted(((False, r.vec_id), list(r.code), r.error) for r in coded.collect()) == brute(short)[0] and books[0].shape == (9, 2)
    for empty in (make(rows[:1]).limit(0), make(bad)):
        coded, books = vc.compress(empty, keep=["label"])
        assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error"] and len(books) == 16


@pytest.mark.parametrize("few", [True, False])
def test_sums_over_equal_keys(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(vc, "broadcast_if_small", lambda df: df)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 7, i) for i in range(500)], "id int, label int, error long")
    want = {}
    for i in range(500):
        want.setdefault(None if i % 3 == 0 else i % 7, []).append(i)
    got = vc.with_group_sum(rows, "label", "error", "s").collect()
    assert len(got) == 500 and all(r.s == sum(want[r.label]) for r in got)
