"""Exact Jaccard join of word-shingle sets: size-aware heavy-light, with linked classes.

Texts with equal sets are one node.  Small sets list all their subsets of the sizes that
a link can need; large sets (and small ones that a large one could link to) are listed
under the prefix of their rarest shingles and met by scanning those lists.  The boundary
is where the cost estimate is least.  Both kinds of list live in one table of postings.

Classes are found without making all pairs of a group: rounds of stars link each node to
one pivot of its lists; after them only pairs of nodes in different classes are checked,
all of them, so no link is lost: a pair left unchecked is already in one class.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import Workspace, broadcast_if_small

WORDS, PERCENT = 5, 80
SLOT_BITS = 24
REPEATS_OF = 1 << 21
BLOCK_BITS = 16
MAX_SMALL = 20
CHECK_COST = 20.0
STAR_ROUNDS = 2
PIVOTS = 4
#: Copies from which on the rows of a node are joined by a broadcast, so no task gets more rows of one.
HOT_COPIES = 100_000
PAIRS_PER_TASK = 4_000_000
#: Bands of set sizes of one long list: sizes of a band differ by a fiftieth.
BANDS = 50.0
#: Pairs of an Arrow batch: each brings two whole sets.
PAIR_BATCH = 32


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def needed(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of sizes a and b."""
    return ceil_div(percent * (a + b), 100 + percent)


def prefix_length(n: int, percent: int) -> int:
    return n - ceil_div(percent * n, 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of size n lists: what it shares with any set it can link to."""
    return sorted({needed(a, a, percent) for a in range(ceil_div(percent * n, 100), n + 1)})


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


@functools.cache
def subsets(n: int, c: int) -> np.ndarray:
    """The places of each subset of c of n elements."""
    return np.array(list(itertools.combinations(range(n), c)), np.int64)


def choose_boundary(rows_of_size: dict[int, int], list_length: float, percent: int) -> int:
    """Largest small size: least sum of subsets listed below it and lists scanned above it."""

    def cost(x: int) -> float:
        small = sum(rows * subset_count(n, percent) for n, rows in rows_of_size.items() if n <= x)
        scanned = sum(rows * prefix_length(n, percent) * (1 + CHECK_COST * list_length) for n, rows in rows_of_size.items() if ceil_div(percent * (x + 1), 100) <= n <= MAX_SMALL)
        return small + scanned

    return min(range(MAX_SMALL + 1), key=lambda x: (cost(x), x))


def sets(chunk: textvec.Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each distinct k-word shingle, by document; a shorter text is one shingle."""
    starts, ends = chunk.words()
    words, owner = chunk.word_ids(starts, ends, lower=True), chunk.doc_of(starts)
    n_words = np.bincount(owner, minlength=chunk.n_docs)
    h, first = textvec.shingles(words, owner, k)
    docs, hashes = [owner[first]], [h]
    for m in range(1, k):
        if (n_words == m).any():
            h, first = textvec.shingles(words, owner, m)
            short = n_words[owner[first]] == m
            docs.append(owner[first][short])
            hashes.append(textvec.mix(h[short] + np.uint64(m)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def sizes_and_nodes(doc: np.ndarray, h: np.ndarray, n_docs: int, clashes: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, the 64-bit node of each set, and 64 bits more that tell sets of one node apart.

    Both are halves of one BLAKE2b digest of the sorted shingles.  Sets in ``clashes``
    (node, check) have the node named there.
    """
    n = np.bincount(doc, minlength=n_docs)
    at, raw, make = np.concatenate([[0], np.cumsum(n)]) * 8, h.tobytes(), hashlib.blake2b
    halves = np.frombuffer(b"".join([make(raw[a:b], digest_size=16, person=b"sets").digest() for a, b in itertools.pairwise(at.tolist())]), np.int64).reshape(-1, 2)
    node, check = halves[:, 0].copy(), halves[:, 1]
    if clashes:
        for i in np.flatnonzero(np.isin(node, [x for x, _ in clashes])):
            node[i] = clashes.get((int(node[i]), int(check[i])), node[i])
    return n, node, check


def settle_clashes(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Nodes for sets that share theirs with another set, by (node, check).

    Of sets with equal nodes, one in 2 ** 64 pairs, all but that of the least check move.
    """
    twice = rows.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").select("node", "low")
    moved = rows.join(twice, "node").where(F.col("check") > F.col("low")).select("node", "check").distinct().collect()
    return {(r["node"], r["check"]): int.from_bytes(hashlib.blake2b(struct.pack("<qq", r["node"], r["check"]), digest_size=8).digest(), "little", signed=True) for r in moved}


def survey(docs: DataFrame, k: int) -> DataFrame:
    """One pass: kind 0 rows (doc_id, set size, node, check), and kind 1 rows (slot, documents) for shingles repeated among REPEATS_OF of a task."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, a: pa.Array, b: np.ndarray, node: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), a, pa.array(b.astype(np.int64)), pa.array(node), pa.array(check)], names=["kind", "a", "b", "node", "check"])

        def repeated(every: list[np.ndarray]) -> pa.RecordBatch:
            shingle = np.concatenate(every)
            every.clear()
            shingle.sort()
            same = np.zeros(len(shingle) + 1, bool)
            same[1:-1] = shingle[1:] == shingle[:-1]
            first = np.flatnonzero(~same[:-1] & same[1:])  # runs of two and more
            times = np.flatnonzero(same[:-1] & ~same[1:]) + 1 - first
            slots = (shingle[first] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            return rows(1, pa.array(slots), times, *[np.zeros(len(slots), np.int64)] * 2)

        every, held = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            found = []
            for chunk in textvec.chunks(batch.column(1)):
                doc, h = sets(chunk, k)
                found.append(sizes_and_nodes(doc, h, chunk.n_docs, {}))
                every.append(h)
                held += len(h)
            if found:
                yield rows(0, batch.column(0), *map(np.concatenate, zip(*found, strict=True)))
            if held >= REPEATS_OF:
                yield repeated(every)
                every, held = [np.zeros(0, np.uint64)], 0
        yield repeated(every)

    return docs.select("doc_id", "text").mapInArrow(seen, "kind int, a long, b long, node long, check long")


def frequency_classes(repeated: DataFrame) -> np.ndarray:
    """A byte per hash slot: four times the binary log of how often shingles of the slot repeat.

    It orders shingles by rough frequency.  Any order that depends on the shingle alone
    gives right results; this one keeps lists short.  2 ** SLOT_BITS bytes at any size,
    which come compressed: the driver's JVM holds rows that it collects several times over.
    """
    low = (1 << BLOCK_BITS) - 1

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << BLOCK_BITS, np.uint8)
        block[part["slot"].to_numpy() & low] = np.minimum(4 * np.log2(part["n"].to_numpy(float)), 255)
        return pd.DataFrame({"block": [int(part["slot"].iloc[0]) >> BLOCK_BITS], "data": [zlib.compress(block.tobytes(), 1)]})

    sums = repeated.groupBy(F.col("a").alias("slot")).agg(F.sum("b").alias("n"))
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in sums.groupBy(F.shiftright("slot", BLOCK_BITS)).applyInPandas(packed, "block long, data binary").collect():
        table[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return table


def postings(docs: DataFrame, k: int, percent: int, frequency: np.ndarray, boundary: int, clashes: dict[tuple[int, int], int]) -> DataFrame:
    """(key, node, n, pos) of every list entry; prefixes are in order of frequency class, then hash.

    Entries for subsets of small sets have the position -1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequency)
    scanned_from = ceil_div(percent * (boundary + 1), 100)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            for chunk in textvec.chunks(batch.column(0)):
                doc, h = sets(chunk, k)
                n, node, _ = sizes_and_nodes(doc, h, chunk.n_docs, clashes)
                load = frequency[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                order = np.lexsort((h, load, doc))
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                pos = np.arange(len(h)) - first[doc]
                length = n - -(-percent * n // 100) + 1
                use = (pos < length[doc]) & (n[doc] >= scanned_from)
                keys, owner, place = [h[order][use].view(np.int64)], [doc[use]], [pos[use]]
                for size in range(1, boundary + 1):  # all sets of a size at once
                    some = np.flatnonzero(n == size)
                    if not len(some):
                        continue
                    own = h[first[some][:, None] + np.arange(size)]
                    for c in subset_sizes(size, percent):
                        made = textvec.mix(np.bitwise_xor.reduce(textvec.mix(own[:, subsets(size, c)] + np.uint64(c)), axis=2)).view(np.int64)
                        keys.append(made.ravel())
                        owner.append(np.repeat(some, made.shape[1]))
                        place.append(np.full(made.size, -1))
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(node[owner]), pa.array(n[owner].astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32))],
                    names=["key", "node", "n", "pos"],
                )

    return docs.select("text").mapInArrow(listed, "key long, node long, n int, pos int")


def node_sets(docs: DataFrame, k: int, clashes: dict[tuple[int, int], int]) -> DataFrame:
    """(node, shingles) of each text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textvec.chunks(batch.column(0)):
                doc, h = sets(chunk, k)
                n, node, _ = sizes_and_nodes(doc, h, chunk.n_docs, clashes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "shingles"])

    return docs.select("text").mapInArrow(made, "node long, shingles array<long>")


def linked(pairs: DataFrame, shingle_sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) whose sets meet the threshold, as links (u, v) between their classes."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.asarray(x.values), np.asarray(y.values)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["u", "v"])

    one = shingle_sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(broadcast_if_small(pairs), "a")
    both = one.join(shingle_sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("ca", "cb", "x", "y").mapInArrow(checked, "u long, v long").distinct()


def components(links: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """(member, root): least member reachable over links (u, v), for members of any link.

    Rounds of taking the least root among neighbours and then the root's root.
    """
    both = workspace.keep(f"{name}-links", links.union(links.select("v", "u")).distinct())
    roots = both.groupBy(F.col("u").alias("member")).agg(F.least(F.min("v"), F.col("member")).alias("root"))
    roots = workspace.keep(f"{name}-0", roots)
    for n in itertools.count(1):
        near = both.join(roots, both["v"] == roots["member"]).groupBy("u").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots["member"] == near["u"]).select("member", "root", F.least("root", "near").alias("lower"))
        up = roots.select(F.col("member").alias("lower"), F.col("root").alias("upper"))
        moved = workspace.keep(f"{name}-{n}", lower.join(up, "lower").select("member", F.least("lower", "upper").alias("root"), (F.least("lower", "upper") < F.col("root")).alias("moved")))
        workspace.drop(f"{name}-{n - 1}")
        roots = moved.select("member", "root")
        if not moved.where("moved").limit(1).count():
            return roots


def _beyond(n: Column, m: Column, percent: int) -> Column:
    """The most that two sets share beyond the lower end of their prefixes."""
    return F.greatest(*[F.ceil(F.lit(percent) * x / F.lit(100)) - 1 for x in (n, m)])


def _possible(percent: int) -> Column:
    """Size filter of a pair with set sizes n and m, and count filter on what entries they have in shared lists at all."""
    n, m = F.col("n"), F.col("m")
    most = F.least("degree", "mdegree")
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & ((F.least("pos", "mpos") < 0) | (most >= _needed(n, m, percent) - _beyond(n, m, percent)))


def _early(percent: int) -> Column:
    """Whether a common entry can be a pair's first in the order of ``rank``.

    A pair that shares t entries has t - 1 behind the first, so that one stands t - 1
    places before the end, at least, on both sides.
    """
    behind = F.greatest(_needed(F.col("n"), F.col("m"), percent) - _beyond(F.col("n"), F.col("m"), percent), F.lit(1)) - 1
    return (F.least("pos", "mpos") < 0) | ((F.col("rank") + behind <= F.col("degree")) & (F.col("mrank") + behind <= F.col("mdegree")))


def _needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _enough_shared(percent: int) -> Column:
    """Position and count filters on pairs with ``times`` common entries, exact as prefixes are in one order.

    From the first common entry on a pair shares at most the shorter rest (``reach``).
    Up to the lower end of the two prefixes all that it shares are common entries;
    beyond it lies at most the rest of the set whose prefix ends there.  Pairs that have
    a subset in common (``low`` is -1) pass.
    """
    n, m = F.col("n"), F.col("m")
    need = _needed(n, m, percent)
    return (F.col("low") < 0) | ((F.col("reach") >= need) & (F.col("times") >= need - _beyond(n, m, percent)))


MATE = {"node": "b", "root": "cb", "n": "m", "pos": "mpos", "degree": "mdegree", "rank": "mrank"}


def _mate(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("key", *more, *[F.col(c).alias(to) for c, to in MATE.items()])


def pairs_of_list(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of entries of different roots in the lists of rows ``mixed`` with their ``main`` root, each pair once."""
    across = (F.col("root") != F.col("cb")) & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("b")))
    return mixed.join(_mate(mixed.where("root != main")), "key").where(across & _possible(percent) & _early(percent))


def pairs_of_long_list(mixed: DataFrame, percent: int) -> DataFrame:
    """As ``pairs_of_list`` for long lists: sizes that no link allows are not joined at all.

    An entry of a set of size n with r shingles from it on shares r at most, so a partner
    of size m needs percent * (n + m) <= (100 + percent) * r, and 100 * m >= percent * n.
    The larger set asks the bands of the sizes m <= n that this leaves, often none.  Within
    a band both sides are dealt over a square of tasks of PAIRS_PER_TASK pairs.
    """
    n, r = F.col("n"), F.col("n") - F.col("pos")
    band = lambda size: F.floor(F.log(size.cast("double")) * BANDS).cast("int")
    # an entry for a subset of a small set (position -1) has no rest to count
    most = F.when(F.col("pos") < 0, n).otherwise(F.least(n, F.floor(F.lit(100 + percent) * r / F.lit(percent)) - n))
    low = F.ceil(F.lit(percent) * n / F.lit(100))
    asks = mixed.withColumn("most", most).where(F.col("most") >= low).withColumn("band", F.explode(F.sequence(band(low), band(F.col("most")))))
    tells = mixed.withColumn("band", band(n))
    number = lambda rows, name: rows.groupBy("key", "band").agg(F.count("*").alias(name))
    sides = number(asks, "a").join(number(tells, "t"), ["key", "band"])
    sides = sides.select("key", "band", F.ceil(F.sqrt(F.col("a") * F.col("t") / F.lit(PAIRS_PER_TASK))).cast("int").alias("side"))
    spread = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    own = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("side")).cast("int")
    asks = asks.join(sides, ["key", "band"]).withColumn("row", own(1)).withColumn("column", spread)
    tells = tells.join(sides, ["key", "band"]).withColumn("column", own(2)).withColumn("row", spread)
    cell = ["key", "band", "row", "column"]
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("node")))
    fits = (F.col("root") != F.col("cb")) & smaller & (F.col("m") <= F.col("most")) & _possible(percent) & _early(percent)
    # the entries of the main root are not joined with each other
    asking, telling = asks.drop("side"), lambda rows: _mate(rows, *cell[1:])
    found = [asking.where("root != main").join(telling(tells), cell), asking.where("root = main").join(telling(tells.where("root != main")), cell)]
    return found[0].unionByName(found[1]).where(fits).drop(*cell[1:], "most")


def classes(docs: DataFrame, workspace: Workspace, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Linked classes of the rows' sets: doc_id, n_shingles, component_id for every row.

    The component is the least doc_id reachable by links (100 * intersection >= percent *
    union), itself included.  A null text, or one without words, has an empty set and is
    linked with nothing; a text of fewer words than a shingle is one shingle.  Equal
    texts, also under a repeated id, are one class.  A null id is never the least while
    another id is there.  Ids are whole numbers, or are cast to them; other columns are not
    read.  Texts of any length are worked on whole.  Words are known by 64-bit SipHash and sets by 128-bit
    BLAKE2b digests.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = workspace.keep("survey", survey(docs, words))
    rows = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "node", "check")
    clashes = settle_clashes(rows.where("n > 0"))
    if clashes:
        moved = spark.createDataFrame([(*k, v) for k, v in clashes.items()], "node long, check long, other long")
        rows = rows.join(F.broadcast(moved), ["node", "check"], "left").withColumn("node", F.coalesce("other", "node")).drop("other")
    rows = rows.drop("check")
    repeated = seen.where("kind = 1")
    frequency = frequency_classes(repeated)
    sizes = rows.groupBy(F.least("n", F.lit(MAX_SMALL + 1)).alias("n")).agg(F.count("*").alias("rows"), F.sum("n").alias("total")).collect()
    total = sum(r["total"] for r in sizes) or 1
    list_length = 1 + float(repeated.agg(F.sum(F.col("b") * F.col("b"))).first()[0] or 0) / total
    boundary = choose_boundary({r["n"]: r["rows"] for r in sizes if 0 < r["n"] <= MAX_SMALL}, list_length, percent)

    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = workspace.keep("nodes", nodes)
    listed = workspace.keep("postings", postings(docs, words, percent, frequency, boundary, clashes))
    shared = listed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("list")).where("low < high").select("key", "list")
    entries = listed.join(shared, "key").groupBy("key", "node").agg(*[F.first(c).alias(c) for c in ("n", "pos", "list")])
    own = Window.partitionBy("node")  # as many entries as a prefix has, or subsets of a small set
    ranked = entries.withColumn("rank", F.row_number().over(own.orderBy("list", "key"))).withColumn("degree", F.count("*").over(own))
    active = workspace.keep("active", ranked)
    workspace.drop("postings")
    met = workspace.keep("met", active.select("node").distinct().join(nodes, "node").select("node", "first_id"))
    roots = met.select("node", F.col("node").alias("root"))

    for n in range(STAR_ROUNDS + 1):
        placed = active.join(broadcast_if_small(roots), "node")
        mates = [F.col(c).alias(to) for c, to in MATE.items()]
        if n < STAR_ROUNDS:
            # a node with many shared entries has few shingles of its own: it stands near the middle of its group
            order = F.struct((-F.shiftright("degree", n)).alias("d"), F.xxhash64("node", F.lit(n)).alias("h"), *mates)
            pivots = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(order).alias("p")).where("low < high").select("key", "p.b", "p.cb", "p.m", "p.mpos", "p.mdegree")
            chosen = placed.join(pivots, "key").where((F.col("root") != F.col("cb")) & _possible(percent))
        else:
            members = placed.groupBy("key", "root").agg(F.count("*").alias("times"))
            largest = members.groupBy("key").agg(F.max(F.struct("times", "root")).alias("first"), F.count("*").alias("roots"), F.sum("times").alias("entries")).where("roots > 1")
            long = F.col("entries") * (F.col("entries") - F.col("first.times")) > PAIRS_PER_TASK
            mixed = placed.join(largest.select("key", F.col("first.root").alias("main"), long.alias("long")), "key")
            chosen = pairs_of_list(mixed.where("NOT long").drop("long"), percent)
            hot = workspace.keep("long", mixed.where("long").drop("long"))  # few, and read several times
            if hot.limit(1).count():
                chosen = chosen.unionByName(pairs_of_long_list(hot, percent).select(chosen.columns))
        sides = ("node", "root", "b", "cb")
        if n == STAR_ROUNDS:  # each pair one way round
            first = F.col("node") < F.col("b")
            sides = [F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("node", "b"), ("root", "cb"), ("b", "node"), ("cb", "root"))]
        ordered = chosen.select(
            *[(F.col(x) if isinstance(x, str) else x).alias(name) for x, name in zip(sides, ("a", "ca", "b", "cb"), strict=True)],
            F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"), F.least("pos", "mpos").alias("pos"), F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("mpos")).alias("reach"), "list",
        )
        counted = ordered.groupBy("a", "b").agg(
            F.count("*").alias("times"), F.min("pos").alias("low"), F.max("reach").alias("reach"), F.min("list").alias("list"), *[F.first(c).alias(c) for c in ("ca", "cb", "n", "m")]
        )
        if n < STAR_ROUNDS:  # the pivots that a node meets most often, and those of its shortest lists; at most one for each entry
            often, rare = (Window.partitionBy("a").orderBy(o, "b") for o in (F.desc("times"), "list"))
            several = counted.withColumn("often", F.row_number().over(often)).withColumn("rare", F.row_number().over(rare))
            counted = several.where((F.col("often") <= PIVOTS) & _enough_shared(percent) | (F.col("rare") <= PIVOTS))
        else:
            found = workspace.keep("found", counted.drop("times", "list"))
            near = active.join(broadcast_if_small(found.select(F.col("a").alias("node")).union(found.select("b")).distinct()), "node", "left_semi")
            # as long as a prefix; written, so that both sides of the joins have shuffles of their own and a hot node's pairs can be split
            lists = workspace.keep("lists", near.groupBy("node").agg(F.collect_list("key").alias("entries")))
            both = found.join(lists.withColumnsRenamed({"node": "a", "entries": "x"}), "a").join(lists.withColumnsRenamed({"node": "b", "entries": "y"}), "b")
            both = both.withColumn("reach", F.col("n"))  # the places are of some common entries only
            counted = both.withColumn("times", F.size(F.array_intersect("x", "y"))).where(_enough_shared(percent))
        pairs = workspace.keep(f"pairs{n}", counted.select("a", "b", "ca", "cb"))
        if not pairs.limit(1).count():
            continue
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(met, "node").select("node", "first_id")
        asked = workspace.keep(f"asked{n}", asked)
        texts = docs.join(broadcast_if_small(asked.select("first_id").distinct()), docs["doc_id"].eqNullSafe(F.col("first_id")), "left_semi")
        shingle_sets = workspace.keep(f"sets{n}", node_sets(texts, words, clashes).join(broadcast_if_small(asked), "node", "left_semi"))
        links = workspace.keep(f"links{n}", linked(pairs, shingle_sets, percent), PAIR_BATCH)
        workspace.drop(f"sets{n}")
        if links.limit(1).count():
            tops = components(links, workspace, f"components{n}").select(F.col("member").alias("root"), F.col("root").alias("top"))
            roots = workspace.keep(f"roots{n}", roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")))

    least = nodes.join(roots, "node", "left").select("node", "first_id", "copies", F.coalesce("root", "node").alias("root"))
    tops = least.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members")).where("members > 1").drop("members")
    named = workspace.keep("named", least.join(tops, "root").select("node", "component_id", "copies"))
    hot = broadcast_if_small(workspace.keep("hot", named.where(F.col("copies") > HOT_COPIES).select("node", F.col("component_id").alias("hot_id"))))
    worded = rows.where("n > 0").join(hot, "node", "left")
    shown = lambda df, of: df.select("doc_id", F.col("n").alias("n_shingles"), of.alias("component_id"))
    cold = worded.where("hot_id is null").join(named.where(F.col("copies") <= HOT_COPIES).drop("copies"), "node", "left")
    parts = shown(rows.where("n = 0"), F.col("doc_id")), shown(worded.where("hot_id is not null"), F.col("hot_id")), shown(cold, F.coalesce("component_id", "doc_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
