r"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of `width` words (A-Z in lower case, words
`[^\x20\x09-\x0D]+`; fewer words: the whole sequence is one shingle; no words: empty, linked with
nothing). Documents link when 100 * intersection >= percent * union, and classes are the connected
components of the links.

1. One pass over the texts makes a HyperMinHash sketch: every register keeps the leading zeros and ten
   mantissa bits of its smallest hash. Registers that stay empty are filled by further rounds of
   hashing, the round being part of the register, so that short texts have full sketches too.
2. Documents with equal sets are one class from the start and appear once from here on.
3. Bands of four registers are hashed to buckets. In every bucket the members are compared with a leader,
   never with each other: first by the collision-corrected estimate from the registers, then, if that is
   not far below the threshold, on the full sets. A member meets its smallest leader first, and a further one
   only if they are still in different components.
4. Buckets whose members lie in different components after that are compared in full, but for pairs already
   connected: up to SMALL members pair by pair as in 3; larger ones in blocks of bounded size, where a
   matrix product in strips counts the shared shingles and a task returns a forest: links that join components that
   no other link of the task has joined. So no pair in a bucket is left out, and none is sent on that does not link.
   (Small buckets pass the estimate first, which loses a pair at 0.8 with probability below 1e-6; blocks do not.)
5. A key that very many rows share (a leader, a hub of links, a class of copies) is broadcast or lent to
   several tasks, so that it is no single task's work.

A pair at 0.8 misses all 32 bands with probability 5e-8.

Defined results: null texts are empty; rows with a null id take no part (component null, kept); rows with
equal ids are one document: their links add up, and they stay or go together; ties cannot arise, the smallest id stands for its component;
extra columns are ignored by `near_duplicates` and untouched by `deduplicated`, whatever their names; empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import map_texts
from panelcast.plans.materialize import broadcast_if_small, materialize

WIDTH, PERCENT = 4, 80
REGISTERS, BAND = 128, 4
MANTISSA, VALUE_BITS = 10, 57
MARGIN = 0.2  # more than five standard deviations of the estimate
SMALL = 16
MOST_BITS = 1 << 27
BLOCK_ROWS, BLOCK_SHINGLES, BLOCK_COLUMNS, STRIP = 1024, 500_000, 1024, 256
HEAVY = 50_000  # rows that share a key, from which on the key is broadcast: rows / HEAVY such keys at most
CHUNK_BYTES = 1_000_000  # texts that are sketched at a time; their hashes take about ten times that
PAIRS_A_TASK = 5_000  # pairs of one node, beyond which it is lent to several tasks

_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. Of bytes, lower() changes A-Z only and split() cuts at \\x20, \\x09-\\x0D."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, width)
    total = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        total = mixed(total * _P + hashes[j : n - size + 1 + j])
    return np.unique(total)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per non-empty set: round << 16 | leading zeros << 10 | mantissa, the smallest hash first."""
    k = REGISTERS
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    registers = np.full(len(sets) * k, -1, np.int32)
    for turn in range(2 * k):
        hashed = mixed(flat + np.uint64(int(_P) * (turn + 1) % 2**64))
        place = hashed >> np.uint64(VALUE_BITS) if turn < k else np.full(len(flat), turn - k, np.uint64)
        value = hashed & np.uint64((1 << VALUE_BITS) - 1)
        slot = owner * k + place.astype(np.int64)
        least = np.full(len(sets) * k, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, slot, value)
        new = np.flatnonzero((registers < 0) & (least != np.iinfo(np.uint64).max))
        x = least[new]
        length = np.frexp(x.astype(np.float64))[1]
        zeros = VALUE_BITS - length
        mantissa = (x << (zeros + 1).astype(np.uint64) & np.uint64((1 << VALUE_BITS) - 1)) >> np.uint64(VALUE_BITS - MANTISSA)
        registers[new] = (turn << 16) | (np.minimum(zeros, 63) << MANTISSA) | mantissa.astype(np.int64)
        short = (registers.reshape(-1, k) < 0).any(axis=1)
        if not short.any():
            break
        keep = short[owner]
        flat, owner = flat[keep], owner[keep]
    return registers.reshape(-1, k)


def collision_rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that registers of unrelated sets agree in zeros and mantissa, for the numbers of hashes in a register.

    The minima have densities n exp(-n x); a level of zeros is cut into 2^MANTISSA equal cells.
    """
    total = np.zeros(len(a))
    for level in range(VALUE_BITS):
        low, high = 2.0 ** -(level + 1), 2.0**-level
        total += low / 2**MANTISSA * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return total * a * b / (a + b)


def estimated(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers, corrected for agreements by chance."""
    agree = (ra == rb).mean(axis=1)
    p = collision_rate(np.maximum(na / REGISTERS, 1.0), np.maximum(nb / REGISTERS, 1.0))
    return (agree - p) / (1 - p)


def sketch_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_shingles, signature (equal for equal sets), registers, bands; the last three null for an empty set."""

    def work(texts: list[bytes]) -> list[list]:
        sets = [shingle_set(t, width) for t in texts]
        full = [s for s in sets if len(s)]
        rows = iter(sketches(full)) if full else iter(())
        made: list[list] = [[], [], [], []]
        for s in sets:
            r = next(rows) if len(s) else None
            made[0].append(len(s))
            made[1].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            made[2].append(None if r is None else r.tobytes())
            if r is None:
                made[3].append(None)
            else:
                key = np.arange(REGISTERS // BAND, dtype=np.uint64)
                for part in r.astype(np.uint64).reshape(-1, BAND).T:
                    key = mixed(key * _P + part)
                made[3].append(key.view(np.int64))
        return made

    fields = "n_shingles bigint, signature binary, registers binary, bands array<bigint>"
    return map_texts(docs, text, [id], fields, work, chunk_bytes=CHUNK_BYTES)


def _paired(pairs: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the named columns of known (keyed by node) for both sides.

    A node of very many pairs is lent to several tasks, its pairs being dealt by their other node. There are at
    most pairs / PAIRS_A_TASK such nodes.
    """
    counted = materialize(pairs, "pairs")
    for side, across in (("a", "b"), ("b", "a")):
        heavy = counted.groupBy(F.col(side).alias("__h")).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("__parts")).filter("__parts > 1")
        heavy = broadcast_if_small(materialize(heavy, "heavy"))
        other = known.select(F.col("node").alias(f"__{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        other = other.join(heavy, F.col(f"__{side}") == F.col("__h"), "left").withColumn(
            "__s", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__h", "__parts")
        dealt = pairs.join(heavy, F.col(side) == F.col("__h"), "left").withColumn(
            "__salt", F.pmod(F.xxhash64(across), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__h", "__parts")
        pairs = dealt.join(other, (F.col(side) == F.col(f"__{side}")) & (F.col("__salt") == F.col("__s"))).drop(f"__{side}", "__s", "__salt")
    return pairs


def _looked_up(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Inner join of rows with known, unique in __k, whose column n counts the rows of a key; n is dropped.

    Keys of more than HEAVY rows are joined by broadcast, so that none of them is one task's work.
    """
    known = materialize(known, "known")
    heavy, light = known.filter(F.col("n") > HEAVY).drop("n"), known.filter(F.col("n") <= HEAVY).drop("n")
    joined = rows.join(light, F.col(key) == F.col("__k"))
    if heavy.isEmpty():
        return joined.drop("__k")
    return joined.unionByName(rows.join(broadcast_if_small(heavy), F.col(key) == F.col("__k"))).drop("__k")


def _likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is not far below the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = {c: np.frombuffer(b"".join(batch.column(f"registers_{c}").to_pylist()), np.int32).reshape(-1, REGISTERS) for c in "ab"}
                sizes = {c: batch.column(f"n_shingles_{c}").to_numpy().astype(float) for c in "ab"}
                likely = estimated(rows["a"], rows["b"], sizes["a"], sizes["b"]) >= percent / 100 - MARGIN
                yield batch.select(["a", "b"]).filter(pa.array(likely))

    # |A and B| / |A or B| is at most the ratio of the sizes.
    fits = (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
    return _paired(pairs, sketched, ["n_shingles", "registers"]).filter(fits).mapInArrow(run, pairs.select("a", "b").schema)


def _among(rows: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The rows whose column is a value of nodes.__node, wide columns and all.

    A Bloom filter of the nodes drops nearly all other rows before the join shuffles them. It has 16 bits a
    node, MOST_BITS at most (16 MB); beyond eight million nodes it lets more through, and the join still decides.
    """
    nodes = materialize(nodes.distinct(), "nodes")
    size = 1 << 16
    wanted = min(MOST_BITS, 16 * nodes.count())
    while size < wanted:
        size *= 2
    hashed = lambda c: [F.xxhash64(c).bitwiseAND(F.lit(size - 1).cast("long")), F.shiftrightunsigned(F.xxhash64(c), 32).bitwiseAND(F.lit(size - 1).cast("long"))]
    places = nodes.select(F.explode(F.array(*hashed("__node"))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @F.arrow_udf("boolean")
    def maybe(first: pa.Array, second: pa.Array) -> pa.Array:
        held = lambda p: (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)
        a, b = (held(v.to_numpy(zero_copy_only=False)) for v in (first, second))
        return pa.array((a & b).astype(bool))

    likely = rows.filter(F.col(column).isNotNull()).withColumns({"__first": hashed(column)[0], "__second": hashed(column)[1]})
    likely = likely.filter(maybe("__first", "__second")).drop("__first", "__second")
    return likely.join(nodes, F.col(column) == F.col("__node"), "left_semi")


def _sets(nodes: DataFrame, docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """node and its full set, for the nodes in the column __node."""

    def sets(texts: list[bytes]) -> list:
        made = [shingle_set(t, width).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
        return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))]

    rows = docs.select(F.col(f"`{id}`").alias("node"), F.col(f"`{text}`").alias("text"))
    return map_texts(_among(rows, "node", nodes), "text", ["node"], "set array<bigint>", sets)


def _confirmed(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, on their full sets: 100 * both >= percent * (a + b - both), solved for both.

    Sets meet row by row in the JVM, so memory holds one pair at a time and not a batch.
    """
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    linked = (100 + percent) * both >= percent * (F.size("set_a").cast("long") + F.size("set_b"))
    return _paired(pairs, known, ["set"]).filter(linked).select("a", "b")


def _leader_links(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b) of leaders and members that join what all linking pairs join: every member meets its
    smallest leader first, and further ones only where that leaves them in different components."""
    pairs = materialize(pairs, "likely")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(_confirmed(first, known, percent), "confirmed")
    labels = materialize(components(links), "labels")
    named = pairs.join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        at = labels.select(F.col("node").alias("__n"), F.col("component").alias(f"__{side}"))
        named = named.join(at, F.col(side) == F.col("__n"), "left").drop("__n")
    rest = named.filter(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b")
    return links.unionByName(_confirmed(rest, known, percent))


def block_links(left: list[np.ndarray], right: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of left and of right that join labels; positions count through left, then right.

    labels has an entry per position. The links are a forest over the labels: at most one fewer than there are
    labels. Counts of shared shingles are float32 (exact below 2^24), one column block at a time; comparisons go
    in strips of rows in int64.
    """
    sets = left + right
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(count > 1) - 1  # only shingles of two or more sets count
    owner, code = owner[count[code] > 1], column[code[count[code] > 1]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    n = len(left)
    shared = np.zeros((n, len(right)), np.float32)
    held = np.zeros((len(sets), BLOCK_COLUMNS), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, BLOCK_COLUMNS):
        part = slice(*np.searchsorted(code, [low, low + BLOCK_COLUMNS]))
        held[:] = 0
        held[owner[part], code[part] - low] = 1
        for top in range(0, n, STRIP):
            shared[top : top + STRIP] += held[top : min(top + STRIP, n)] @ held[n:].T
    _, roots = np.unique(labels, return_inverse=True)
    parent, found = list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for top in range(0, n, STRIP):
        both = shared[top : top + STRIP].astype(np.int64)
        rows = np.arange(top, min(top + STRIP, n))
        linked = (100 + percent) * both >= percent * (sizes[rows][:, None] + sizes[n:][None, :])
        a, b = np.nonzero(linked & (roots[rows][:, None] != roots[n:][None, :]))
        if not len(a):
            continue
        a, b = rows[a], b + n
        _, first = np.unique(roots[a] * len(sets) + roots[b], return_index=True)  # one link for each pair of labels
        for i, j in zip(a[first].tolist(), b[first].tolist()):
            x, y = root(int(roots[i])), root(int(roots[j]))
            if x != y:
                parent[x] = y
                found.append((i, j))
        roots = np.array([root(x) for x in range(len(sets))])[roots]  # later strips skip what is joined now
    return found


def _block_links(large: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within the buckets of large: key, node, component, n_shingles, n, total."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = large.select("key", "node", "component", blocks.alias("__blocks"), F.pmod(F.xxhash64("key", "node"), blocks).cast("int").alias("block"))
    met = placed.select("key", "node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("other"))
    met = met.select("key", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(rows):
        sides = [rows[rows["block"] == rows["i"].iloc[0]], rows[rows["block"] == rows["j"].iloc[0]]]
        sets = [list(side["set"]) for side in sides]
        nodes = np.concatenate([side["node"].to_numpy() for side in sides])
        found = block_links(*sets, np.concatenate([side["component"].to_numpy() for side in sides]), percent) if all(sets) else []
        return type(rows)({"a": nodes[[a for a, _ in found]], "b": nodes[[b for _, b in found]]})

    kind = large.schema["node"].dataType.simpleString()
    sets = known.withColumnRenamed("node", "__n")
    return met.join(sets, F.col("node") == F.col("__n")).drop("__n").groupBy("key", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of links (a, b), by alternating star operations.

    All steps aggregate before they shuffle and join a unique key; hubs of very many links are joined by broadcast.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links, mark = materialize(links, "links"), None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31).cast("long")))).first()
        if now == mark or now[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
        # large star: larger neighbours of u move to the smallest neighbour of u
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("__k")).agg(F.min(F.least("a", "b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _looked_up(both, "a", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        large = materialize(large, "large-star")
        least = large.groupBy(F.col("a").alias("__k")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _looked_up(large, "a", least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = materialize(small.unionByName(least.select(F.col("__k").alias("a"), F.col("m").alias("b"))).distinct(), "links")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    sketched = materialize(sketch_documents(docs, id, text, width).withColumnRenamed(id, "id"), "sketches")
    # Equal sets: the smallest id stands for the class, here called node.
    classes = sketched.filter("id IS NOT NULL").groupBy("signature").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).filter("signature IS NOT NULL")
    classes = materialize(classes, "classes")
    # Buckets first, heads of classes after: so only narrow rows of shared buckets are joined with the classes.
    places = sketched.filter("id IS NOT NULL").select("id", F.explode("bands").alias("key"))
    shared = places.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    met = places.join(shared.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key")).select("key", F.col("id").alias("node"), "low")
    members = materialize(met.join(classes.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_semi"), "members")
    heads = sketched.filter("signature IS NOT NULL").select(F.col("id").alias("node"), "n_shingles", "registers")
    heads = materialize(_among(heads, "node", members.filter("node <> low").select(F.explode(F.array("node", "low")).alias("__node"))), "heads")

    pairs = members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    tested = materialize(pairs, "tested")
    likely = materialize(_likely(tested, heads, percent), "likely")
    known = materialize(_sets(likely.select(F.explode(F.array("a", "b")).alias("__node")), docs, id, text, width), "sets")
    labels = materialize(components(_leader_links(likely, known, percent)), "labels")
    named = members.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    split = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    sized = named.join(split.select(F.col("key").alias("__k"), "n"), F.col("key") == F.col("__k")).drop("__k")
    members = materialize(sized, "split-members")
    few = members.filter(F.col("n") <= SMALL)
    other = few.select(F.col("key").alias("__key"), F.col("node").alias("__node"), F.col("component").alias("__component"))
    pairs = few.join(other, (F.col("key") == F.col("__key")) & (F.col("node") < F.col("__node")) & (F.col("component") != F.col("__component"))).select(
        F.col("node").alias("a"), F.col("__node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    likely = materialize(_likely(pairs, heads, percent), "likely")
    many = members.filter(F.col("n") > SMALL)
    wanted = likely.select(F.explode(F.array("a", "b")).alias("__node")).unionByName(many.select(F.col("node").alias("__node")))
    known = materialize(_sets(wanted, docs, id, text, width), "sets")
    links = _confirmed(likely, known, percent)
    size = heads.select(F.col("node").alias("__n"), "n_shingles")
    many = materialize(many.join(size, F.col("node") == F.col("__n")).drop("__n"), "large-buckets")
    total = many.groupBy(F.col("key").alias("__k")).agg(F.sum("n_shingles").alias("total"))
    blocks = _block_links(many.join(total, F.col("key") == F.col("__k")).drop("__k"), known, percent)
    labels = materialize(_joined(labels, links.unionByName(blocks)), "labels")

    named = classes.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select(
        F.col("signature").alias("__k"), F.coalesce("component", "node").alias("component"), "n")
    ids = sketched.select("id", "n_shingles", "signature")
    alone = ids.filter("id IS NULL OR signature IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    grouped = _looked_up(ids.filter("id IS NOT NULL AND signature IS NOT NULL"), "signature", named).select(
        "id", "n_shingles", F.col("component").alias("component_id"))
    return grouped.unionByName(alone).select(
        F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their component, all columns unchanged."""
    gone = near_duplicates(docs, id, text, width, percent).filter("NOT kept").select(id).distinct()
    return docs.join(gone, [id], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
