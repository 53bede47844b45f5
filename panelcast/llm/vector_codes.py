"""Compact codes for vectors: exact k-means on vector parts, sped up by anchors-hierarchy metric trees.

A component x becomes the integer floor(256 x), vectors are cut into `parts` equal consecutive pieces, and
every part position has a codebook of `entries` integer vectors. It starts as that part of the
vectors with the smallest ids; a round assigns every part to the nearest entry (squared Euclidean
distance, ties to the lower index) and replaces an entry by floor(sum / count) of its parts.

1. Vectors are read once into blocks of BLOCK rows. In every block and for each part a metric tree
   is grown middle-out: about sqrt(n) anchors each take the points nearest to them, a new anchor being the
   point furthest from its own anchor and only points beyond half the distance between two
   anchors being compared; anchors merge upwards in pairs of least joint radius and split downwards in
   the same way. A ball caches centre, radius, count and sum. Blocks and trees are written out.
2. In a round the entries go down the trees. A ball inherits its parent's list of candidates and
   strikes out each entry that is further from all of the ball than the nearest one: with r the radius, when
   (d(c, e)^2 - d(c, best)^2) / 2 d(e, best) > r. A ball with one candidate left is wholly owned and adds
   its cached sum and count; in leaves the remaining candidates are compared exactly, in integers.
3. A block returns one partial sum per part and entry, so a round shuffles parts * entries small rows a task,
   and only the codebooks (parts * entries integer vectors) pass through the driver.

The trees only save work: codes, distances and codebooks do not depend on how rows fall into blocks.

Defined results: a vector that is null, empty, or holds null or non-finite components is dropped; a vector of
another length than the kept vector with the smallest id, or with a component whose square would leave 64 bits
(|floor(256 x)| >= 2^30 / sqrt(length)), is kept with null code and error, and is not learnt from. Lengths that
`parts` does not divide are filled up with zeros. Null ids come last in the order of ids, repeated ids are ordered by their
vectors; repeated rows count as often as they occur. With fewer rows than entries the codebooks are shorter. Equal entries: the
lower index takes all. Extra columns are dropped unless named in `keep`; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import math
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from panelcast.plans.materialize import broadcast_if_small, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 2048  # rows in a block of trees
LEAF = 48  # points below which a ball is not split
SALTS = 32

_TREE = "center array<double>, radius array<double>, number array<bigint>, total array<bigint>, left array<int>, right array<int>, first array<int>, items array<int>"


class Tree(NamedTuple):
    """Balls in an order with parents before children; ball i holds points items[first[i] : first[i] + number[i]]."""

    center: np.ndarray
    radius: np.ndarray
    number: np.ndarray
    total: np.ndarray
    left: np.ndarray  # children, -1 for a leaf
    right: np.ndarray
    first: np.ndarray
    items: np.ndarray


def anchors(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The points of x dealt to up to `most` anchors; every point belongs to its nearest one."""
    first = np.sqrt(((x - x[0]) ** 2).sum(1))
    order = np.argsort(-first, kind="stable")
    pivots, owned, far = [x[0]], [order], [first[order]]  # furthest first
    while len(pivots) < most:
        widest = max(range(len(pivots)), key=lambda i: far[i][0])
        if far[widest][0] <= 0:
            break
        pivot = x[owned[widest][0]]
        gaps = np.sqrt(((np.array(pivots) - pivot) ** 2).sum(1))
        taken, taken_far = [], []
        # A point nearer to its anchor than half the gap cannot be nearer to the new one.
        for i in np.flatnonzero(np.array([f[0] for f in far]) >= gaps / 2):
            reach = int(np.searchsorted(-far[i], -gaps[i] / 2, side="right"))
            some = owned[i][:reach]
            new = np.sqrt(((x[some] - pivot) ** 2).sum(1))
            moves = new < far[i][:reach]
            if moves.any():
                taken.append(some[moves])
                taken_far.append(new[moves])
                stay = np.ones(len(owned[i]), bool)
                stay[:reach] = ~moves
                owned[i], far[i] = owned[i][stay], far[i][stay]
        mine, mine_far = np.concatenate(taken), np.concatenate(taken_far)
        order = np.argsort(-mine_far, kind="stable")
        pivots.append(pivot)
        owned.append(mine[order])
        far.append(mine_far[order])
    return owned


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    center = x.mean(0)
    return center, float(np.sqrt(((x - center) ** 2).sum(1).max()))


def grow(points: np.ndarray) -> Tree:
    """The metric tree of integer points."""
    x = points.astype(np.float64)
    center, radius, number, left, right, first, items = [], [], [], [], [], [], []
    filled = 0

    def place(tree, parent: int, side: list) -> None:
        """Number a nested tree depth first; tree is an array of points or a pair of trees."""
        nonlocal filled
        stack = [(tree, parent, side)]
        while stack:
            tree, parent, side = stack.pop()
            me = len(center)
            if parent >= 0:
                side[parent] = me
            whole = gathered(tree)
            c, r = ball(x[whole])
            center.append(c)
            radius.append(r)
            number.append(len(whole))
            left.append(-1)
            right.append(-1)
            first.append(filled)
            if isinstance(tree, np.ndarray) and (len(tree) <= LEAF or r == 0):
                items.append(tree)
                filled += len(tree)
                continue
            if isinstance(tree, np.ndarray):
                tree = middle_out(tree)
            stack.append((tree[1], me, right))
            stack.append((tree[0], me, left))

    def gathered(tree) -> np.ndarray:
        if isinstance(tree, np.ndarray):
            return tree
        found, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, np.ndarray):
                found.append(t)
            else:
                stack += t
        return np.concatenate(found)

    def middle_out(some: np.ndarray):
        """Anchors of some points, merged upwards into a pair of trees."""
        groups = anchors(x[some], max(2, math.isqrt(len(some))))
        nodes = [some[g] for g in groups]
        trees: list = list(nodes)
        balls = [ball(x[n]) for n in nodes]
        centers = np.array([b[0] for b in balls])
        radii = np.array([b[1] for b in balls])
        sizes = np.array([float(len(n)) for n in nodes])
        while len(trees) > 2:
            # Radius of the ball around two balls.
            gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
            joint = np.maximum(np.maximum(radii[:, None], radii[None]), (gap + radii[:, None] + radii[None]) / 2)
            joint[np.diag_indices(len(trees))] = np.inf
            a, b = sorted(np.unravel_index(int(np.argmin(joint)), joint.shape))
            trees[a] = (trees[a], trees[b])
            centers[a] = (centers[a] * sizes[a] + centers[b] * sizes[b]) / (sizes[a] + sizes[b])
            radii[a], sizes[a] = joint[a, b], sizes[a] + sizes[b]
            del trees[b]
            centers, radii, sizes = (np.delete(v, b, axis=0) for v in (centers, radii, sizes))
        return tuple(trees)

    place(np.arange(len(x)), -1, left)
    order = np.concatenate(items)
    sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order].astype(np.int64), axis=0)])
    first, number = np.array(first), np.array(number)
    return Tree(np.array(center), np.array(radius), number, sums[first + number] - sums[first], np.array(left), np.array(right), first, order)


def first_equals(book: np.ndarray) -> np.ndarray:
    """Which entries differ from all entries before them; the others can win no part."""
    _, index = np.unique(book, axis=0, return_index=True)
    keep = np.zeros(len(book), bool)
    keep[index] = True
    return keep


def owners(tree: Tree, points: np.ndarray, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (balls, entries): each ball is wholly owned by that entry; single points of leaves appear as -1 - point.

    Both arrays have equal length, and every point is met once, in its ball or alone.
    """
    entries = book.astype(np.float64)
    between = 2 * np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2))
    balls, candidates = np.zeros(1, np.int64), np.broadcast_to(first_equals(book), (1, len(book)))
    while len(balls):
        d = ((tree.center[balls][:, None] - entries[None]) ** 2).sum(2)
        d[~candidates] = np.inf
        best = d.argmin(1)
        excess = d - d[np.arange(len(balls)), best][:, None]
        # A margin for rounding: an entry is struck out only if it is further away beyond doubt.
        candidates = candidates & ~(excess > between[best] * (tree.radius[balls][:, None] * (1 + 1e-9) + 1e-6))
        alone = candidates.sum(1) == 1
        yield balls[alone], best[alone]
        balls, candidates = balls[~alone], candidates[~alone]
        leaf = tree.left[balls] < 0
        if leaf.any():
            spread = tree.number[balls[leaf]]
            start = np.repeat(tree.first[balls[leaf]] - np.r_[0, np.cumsum(spread)[:-1]], spread)
            point = tree.items[start + np.arange(len(start))]
            exact = ((points[point][:, None].astype(np.int64) - book[None]) ** 2).sum(2)
            exact[~np.repeat(candidates[leaf], spread, axis=0)] = np.iinfo(np.int64).max
            yield -1 - point, exact.argmin(1)  # the first of equals
        inner = balls[~leaf]
        balls = np.concatenate([tree.left[inner], tree.right[inner]])
        candidates = np.concatenate([candidates[~leaf]] * 2)


def totals(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points that each entry takes."""
    count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    for who, entry in owners(tree, points, book):
        whole = who >= 0
        np.add.at(count, entry[whole], tree.number[who[whole]])
        np.add.at(total, entry[whole], tree.total[who[whole]])
        np.add.at(count, entry[~whole], 1)
        np.add.at(total, entry[~whole], points[-1 - who[~whole]])
    return count, total


def assigned(tree: Tree, points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entry of every point."""
    out = np.zeros(len(points), np.int64)
    for who, entry in owners(tree, points, book):
        whole = who >= 0
        out[-1 - who[~whole]] = entry[~whole]
        for b, e in zip(who[whole], entry[whole]):
            out[tree.items[tree.first[b] : tree.first[b] + tree.number[b]]] = e
    return out


def integer_vectors(vectors: DataFrame, id: str, vector: str, keep: list[str], parts: int, scale: int) -> tuple[DataFrame, int]:
    """id, keep and __v (array of long; null where no code can be given) of the vectors that are kept, and the padded length."""
    x = F.col(f"`{vector}`")
    finite = F.coalesce(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size(x) > 0), F.lit(False))
    names = list(dict.fromkeys([id, *keep]))
    kept = vectors.filter(finite).select(*[F.col(f"`{k}`") for k in names], F.transform(x, lambda c: c.cast("double")).alias("__x"))
    smallest = kept.orderBy(F.col(f"`{id}`").asc_nulls_last(), "__x").select(F.size("__x")).first()
    if smallest is None:
        return kept.select(*names, F.lit(None).cast("array<bigint>").alias("__v")), parts
    size = smallest[0]
    limit = 2.0**30 / math.sqrt(size)
    padded = -(-size // parts) * parts
    scaled = F.transform("__x", lambda c: F.floor(c * scale))
    fits = (F.size("__x") == size) & ~F.exists("__x", lambda c: F.abs(c * scale) >= limit)
    filled = F.concat(scaled, F.array_repeat(F.lit(0).cast("bigint"), padded - size)) if padded > size else scaled
    return kept.select(*names, F.when(fits, filled).alias("__v")), padded


def _blocks(rows: DataFrame, carried: list[str], size: int, parts: int) -> DataFrame:
    """One row per block: the carried columns as arrays, the vectors, and a tree for each part."""
    kinds = {f"c{i}": T.ArrayType(rows.schema[k].dataType) for i, k in enumerate(carried)}
    tree = T.ArrayType(T.StructType.fromDDL(_TREE))
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()] + [T.StructField("v", T.ArrayType(T.LongType())), T.StructField("trees", tree)])
    width = size // parts

    def built(table: pa.Table) -> pa.RecordBatch:
        flat = table.column("__v").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        trees = []
        for p in range(parts):
            t = grow(v[:, p * width : (p + 1) * width])
            trees.append({f: np.asarray(a).ravel() for f, a in t._asdict().items()})
        made = [pa.ListArray.from_arrays([0, table.num_rows], table.column(k).combine_chunks()) for k in carried]
        made.append(pa.ListArray.from_arrays([0, table.num_rows * size], pa.array(v.ravel())))
        made.append(pa.array([trees], type=to_arrow_type(tree)))
        return pa.RecordBatch.from_arrays(made, names=schema.fieldNames())

    def run(batches):
        held, n = [], 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, BLOCK - n)
                held.append(part)
                n += part.num_rows
                start += part.num_rows
                if n == BLOCK:
                    yield built(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield built(pa.Table.from_batches(held))

    return rows.select(*carried, "__v").mapInArrow(run, schema)


def _read_block(batch: pa.RecordBatch, row: int, size: int, parts: int) -> Iterator[tuple[int, Tree, np.ndarray]]:
    """part, tree and points of one block."""
    v = batch.column("v")[row].values.to_numpy(zero_copy_only=False).reshape(-1, size)
    width = size // parts
    trees = batch.column("trees")[row].values
    for p in range(parts):
        arrays = {f: trees.field(f)[p].values.to_numpy(zero_copy_only=False) for f in Tree._fields}
        arrays["center"] = arrays["center"].reshape(-1, width)
        arrays["total"] = arrays["total"].reshape(-1, width)
        yield p, Tree(**arrays), v[:, p * width : (p + 1) * width]


def one_round(blocks: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after one assignment of all blocks."""
    parts = len(books)
    shared = blocks.sparkSession.sparkContext.broadcast(books)  # parts * entries integer vectors

    def run(batches):
        books = shared.value
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for p, tree, points in _read_block(batch, row, size, parts):
                    c, t = totals(tree, points, books[p])
                    count[p] += c
                    total[p] += t
        used = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p]).tolist()]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([e for _, e in used], pa.int32()),
            "n": pa.array([int(count[p][e]) for p, e in used], pa.int64()),
            "total": pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
        })

    partial = blocks.select("v", "trees").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    width = size // parts
    sums = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    made = [b.copy() for b in books]
    for r in sums.collect():  # parts * entries rows
        made[r["part"]][r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return made


def codebook_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, keep, code as array<int>, error) of the kept vectors, and the final codebooks, one array (entry, place) a part."""
    carried = list(dict.fromkeys([id, *(keep or [])]))
    every, size = integer_vectors(vectors, id, vector, carried, parts, scale)
    usable = every.filter("__v IS NOT NULL")
    seeds = usable.orderBy(F.col(f"`{id}`").asc_nulls_last(), "__v").limit(entries).select("__v").collect()
    start = np.array([r[0] for r in seeds], np.int64).reshape(len(seeds), size)
    books = [start[:, p * size // parts : (p + 1) * size // parts] for p in range(parts)]
    coded_type = T.StructType([T.StructField(k, every.schema[k].dataType) for k in carried]).add("code", T.ArrayType(T.IntegerType())).add("error", T.LongType())
    uncoded = every.filter("__v IS NULL").select(*carried, F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if not len(seeds):
        return uncoded, books
    blocks = materialize(_blocks(usable, carried, size, parts), "vector-blocks")
    for _ in range(rounds):
        books = one_round(blocks, books, size)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                codes, error = [], 0
                for p, tree, points in _read_block(batch, row, size, parts):
                    codes.append(assigned(tree, points, books[p]))
                    error = error + ((points - books[p][codes[-1]]) ** 2).sum(1)
                code = np.stack(codes, 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32) * parts, pa.array(code.ravel()))
                kept = [batch.column(f"c{i}")[row].values for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(error)], names=coded_type.fieldNames())

    return blocks.mapInArrow(run, coded_type).unionByName(uncoded), books


def with_group_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Append the sum of a value over rows of equal key, nulls together; a key may hold any share of the rows.

    Sums are made with partial results on the map side. Where there are too many keys to broadcast, each sum is
    lent to SALTS places, so that the rows of a frequent key are met in as many tasks.
    """
    sums = rows.groupBy(F.col(key).alias("__k")).agg(F.sum(value).alias(out))
    few = broadcast_if_small(sums)
    if few is not sums:
        return rows.join(few, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")
    salted = sums.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__salt") == F.col("__s")), "left").drop("__k", "__s", "__salt")
