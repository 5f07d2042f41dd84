"""Components of sets that are alike: from shared signatures to verified links, without the pairs of a group ever being listed.

Nodes are 64-bit hashes of distinct sets; a signature is a 64-bit value such that any two linked nodes share one. Sets that
share a signature make up a list. Lists are not expanded to pairs: every member is first compared with one hub of its list,
round after round with other hubs, and pairs that are already in one component are never compared. What remains are lists
whose members, hubs aside, still lie in several components; those are compared in blocks, through parity sketches that
can't miss a link. A block gives a forest over the pairs that these leave, so no more rows than members; the trees over all
lists are clusters that no link leaves, and within these the exact sets meet, each in one cluster only.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import large_batches, scratch, sendable, written

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes."""
    n = len(words) - size + 1
    h = np.full(max(n, 0), np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            h = mix(h * _M2 + words[k : k + n])
    return h


def shingle_sets(lists: list[list], table: dict, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each list of words; a shorter list is one shingle, an empty list gives none."""
    ends = np.cumsum([len(x) for x in lists])
    words = np.fromiter(map(table.__getitem__, itertools.chain.from_iterable(lists)), np.uint64, int(ends[-1]) if len(lists) else 0)
    shingles = shingle_hashes(words, size)
    at = 0
    for end in ends:
        if end - at >= size:
            yield np.unique(shingles[at : end - size + 1])
        elif end > at:
            yield shingle_hashes(words[at:end], int(end - at))
        else:
            yield words[:0]
        at = end


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a sorted set."""
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64))[0]
        b = mix(np.array([mix(s ^ _M1).sum() + np.uint64(len(s))], np.uint64))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n - shared)


PARITY_WORDS = 8


def parity(s: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """64 * words bits, each the parity of the elements hashed to it. Two sets' sketches differ in no more bits than the sets in elements."""
    bits = np.bincount((mix(s) % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def wide_parity(s: np.ndarray) -> np.ndarray:
    """A sketch as wide as a set needs, a power of two of words; empty where PARITY_WORDS do.

    Sketches of w bits of unlike sets differ in w / 2 at most, so those of large sets rule nothing out unless they are wide.
    """
    words = PARITY_WORDS
    while 4 * 64 * words < 3 * len(s):
        words *= 2
    return parity(s, words) if words > PARITY_WORDS else s[:0]


def folded(p: np.ndarray, words: int) -> np.ndarray:
    """The narrower sketch of the same set."""
    while len(p) > words:
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    return p


def one_hash_each(df: DataFrame, differ: str) -> None:
    """Hashes of different sets that agree in 64 bits are found by a second hash."""
    if df.where(differ).limit(1).count():
        raise ValueError("two different sets share a 64-bit hash; run again with another seed")


def nodes_of(rows: DataFrame, *first: str) -> DataFrame:
    """(h, first...): the least row of each distinct set, as a struct `first`; `rows` has h, h2 and the columns named."""
    out = written(rows.groupBy("h").agg(F.min(F.struct(*first)).alias("first"), F.min("h2").alias("_lo"), F.max("h2").alias("_hi")), "nodes")
    one_hash_each(out, "_lo <> _hi")
    return out.drop("_lo", "_hi")


def connected(edges: DataFrame) -> DataFrame:
    """(h, comp) of every node in `edges` (a, b): comp is the least node of its component. Large-star and small-star rounds; a node's edges are never gathered."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = e.join(least, "a")
        if large:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return own.union(out.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now = written(edges.select("a", "b").where("a <> b").distinct(), "cc")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = star(both, True)
        down = wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = written(star(down, False), "cc")
        # done when every node has one edge down, to a node that has none
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(now.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 OR (up = 1 AND low = 1)").limit(1).count():
            break
    own = now.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("h"), "comp")
    return own.union(own.select(F.col("comp").alias("h"), "comp").distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (h, s) are alike."""
    left, right = sets.select(F.col("h").alias("a"), F.col("s").alias("x")), sets.select(F.col("h").alias("b"), F.col("s").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def keep(batches):
        for b in batches:
            xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(keep, "a long, b long")


def _sketched(batches):
    for b in batches:
        s = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in s], pa.int32()), pa.array([parity(x).tobytes() for x in s], pa.binary())], ["h", "n", "p"])


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches (h, n, p) don't rule out: none that is alike is lost, and sets are joined to few."""
    m, n = sketches.select(F.col("h").alias("a"), F.col("n").alias("m")), sketches.select(F.col("h").alias("b"), "n")
    x, y = sketches.select(F.col("h").alias("a"), F.col("p").alias("x")), sketches.select(F.col("h").alias("b"), F.col("p").alias("y"))
    # sizes rule out most pairs, so sketches travel with few
    sized = pairs.join(m, "a").join(n, "b").where(100 * F.least("m", "n").cast("long") >= percent * F.greatest("m", "n").cast("long"))
    sized = sized.join(y, "b").join(x, "a").select("a", "b", "m", "n", "x", "y")

    def keep(batches):
        for b in batches:
            n = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, PARITY_WORDS) for k in (4, 5))
            good = np.bitwise_count(x ^ y).sum(1) <= n * (100 - percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return sized.mapInArrow(keep, "a long, b long")


def closer(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that wide sketches (h, n, w) don't rule out either; a pair of which one set has none stays."""
    left, right = wide.select(F.col("h").alias("a"), F.col("n").alias("m"), F.col("w").alias("x")), wide.select(F.col("h").alias("b"), "n", F.col("w").alias("y"))
    both = pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", "m", "n", "x", "y")

    def near(m, n, x, y) -> bool:
        if x is None or y is None:
            return True
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        words = min(len(x), len(y))
        return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= (m + n) * (100 - percent) // (100 + percent)

    def keep(batches):
        for b in batches:
            good = [near(*r) for r in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(keep, "a long, b long")


def shared_lists(signatures: DataFrame) -> DataFrame:
    """(sig, h, hub) of the lists with two different members at least, each member once; the hub is the least.

    One shuffle: a task reads its lists in order and keeps one value of them at a time, so a list's length costs no memory.
    """

    def lists(batches):
        sig, h, hub = None, None, None  # of the row before; its list's first
        for b in batches:
            s, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(s):
                continue
            first = np.r_[s[0] != sig, s[1:] != s[:-1]] if sig is not None else np.r_[True, s[1:] != s[:-1]]
            again = np.r_[not first[0] and x[0] == h, (x[1:] == x[:-1]) & ~first[1:]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
            hubs = np.where(at >= 0, x[at], hub if hub is not None else 0)
            keep = (x != hubs) & ~again
            sig, h, hub = s[-1], x[-1], hubs[-1]
            # a hub is given with each of its members, so that lists of one member are never given
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(x[keep]), pa.array(hubs[keep])], ["sig", "h", "hub"])

    return signatures.select("sig", "h").repartition("sig").sortWithinPartitions("sig", "h").mapInArrow(lists, "sig long, h long, hub long")


#: Members of a list that are compared with each other at a time.
BLOCK = 512
#: Bytes of sets that a block of a cluster has, about.
BLOCK_BYTES = 8 << 20


class Forest:
    """Trees over `labels`, one a number: rows with one label are in one tree."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1] if len(labels) else labels

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were in different trees, which are one then."""
        if self.of[a] == self.of[b]:
            return False
        self.of[self.of == self.of[b]] = self.of[a]
        return True


def _in_blocks(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """`rows` with (own, i, j): the members of a `key` are dealt into its `blocks` (key, blocks) by hash of h, and each goes to every pair of blocks (i, j) that has its own."""
    dealt = rows.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _by_pair_of_blocks(batches, columns: int) -> Iterator[list[tuple]]:
    """The rows of each (key, i, j), the first three of so many columns; batches come in their order."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(columns)), strict=True):
            if r[:3] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = r[:3], []
            rows.append(r)
    if len(rows) > 1:
        yield rows


def _block_pairs(left: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """Pairs (a, b) within lists (sig, h, comp, n, p, perhaps w) that differ in component and whose sketches allow a link.

    A list's members are dealt into blocks of about BLOCK by hash, and a task takes a pair of blocks; a member goes to as many
    tasks as its list has blocks. With `forest` a task gives only so many of its pairs that they connect what all of them do.
    """
    if "w" not in left.columns:
        left = left.withColumn("w", F.lit(None).cast("binary"))
    left = left.withColumn("p", F.when(F.length("w") > 0, None).otherwise(F.col("p")))  # a wide one folds to it
    sizes = left.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = _in_blocks(left, "sig", sizes).select("sig", "i", "j", "own", "h", "comp", "n", "p", "w")

    def pairs(batches):
        for rows in _by_pair_of_blocks(batches, 9):
            yield from found(rows)

    def found(rows):
        own, h, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
        wide = [np.frombuffer(r[8] or b"", np.uint64) for r in rows]
        p = np.stack([folded(w, PARITY_WORDS) if len(w) else np.frombuffer(r[7], np.uint64) for w, r in zip(wide, rows, strict=True)])
        words = np.array([len(w) for w in wide])
        levels = {}  # words: the sketches of rows that have as many or more, and where a row's is
        for k in np.unique(words[words > 0]).tolist():
            has = words >= k
            levels[k] = np.stack([folded(wide[i], k) for i in np.flatnonzero(has)]), np.cumsum(has) - 1
        crossed = rows[0][1] != rows[0][2]
        trees = Forest(np.arange(len(rows))) if forest else None
        for a in range(len(rows) - 1):
            far = (n[a] + n[a + 1 :]) * (100 - percent) // (100 + percent)
            near = (np.bitwise_count(p[a] ^ p[a + 1 :]).sum(1) <= far) & (comp[a] != comp[a + 1 :])
            near &= 100 * np.minimum(n[a], n[a + 1 :]) >= percent * np.maximum(n[a], n[a + 1 :])
            if crossed:
                near &= own[a] != own[a + 1 :]
            if trees:
                near &= trees.of[a] != trees.of[a + 1 :]
            at = a + 1 + np.flatnonzero(near)
            for k, (sketch, row) in levels.items() if len(at) else ():
                those = at[np.minimum(words[a], words[at]) == k]
                far_off = np.bitwise_count(sketch[row[a]] ^ sketch[row[those]]).sum(1) > (n[a] + n[those]) * (100 - percent) // (100 + percent) if len(those) else np.zeros(0, bool)
                at = np.setdiff1d(at, those[far_off], assume_unique=True)
            if trees:
                at = np.array([b for b in at.tolist() if trees.join(a, b)], np.int64)
            if len(at):
                lo, hi = np.minimum(h[a], h[at]), np.maximum(h[a], h[at])
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(pairs, "a long, b long").distinct()


def local_levels(sets: list[np.ndarray]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(words, levels) of sets whose sketches are 4 to 8 bits wide an element: the words of each, and by number of words the sketches of those that have as many or more, and where a set's is."""
    words = np.array([max(PARITY_WORDS, 1 << max(0, 4 * len(s) - 1).bit_length() >> 6) for s in sets])
    own, levels = [parity(s, int(k)) for s, k in zip(sets, words, strict=True)], {}
    for k in np.unique(words).tolist():
        has = words >= k
        levels[k] = np.stack([folded(own[i], k) for i in np.flatnonzero(has)]), np.cumsum(has) - 1
    return words, levels


def block_links(clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within clusters (cluster, h, comp, s), so many that they connect what all links of a cluster do with the components there.

    Members meet in blocks of about BLOCK sets or BLOCK_BYTES bytes. A pair of different components is compared by size, by a
    sketch of 4 bits an element or more, which is made from the sets on the spot, and by the sets.
    """
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("s")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = _in_blocks(clusters, "cluster", blocks).select("cluster", "i", "j", "own", "h", "comp", "s")

    def links(batches):
        for rows in _by_pair_of_blocks(batches, 7):
            yield from found(sorted(rows, key=lambda r: len(r[6])))

    def found(rows):
        own, h, comp = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        words, levels = local_levels(sets)
        ends = np.searchsorted(n, 100 * n // percent, "right")
        crossed, trees, out = rows[0][1] != rows[0][2], Forest(comp), []
        for a, end in enumerate(ends.tolist()):
            at = a + 1 + np.flatnonzero(trees.of[a + 1 : end] != trees.of[a])
            if crossed:
                at = at[own[at] != own[a]]
            if not len(at):
                continue
            sketch, row = levels[int(words[a])]
            at = at[np.bitwise_count(sketch[row[a]] ^ sketch[row[at]]).sum(1) <= (n[a] + n[at]) * (100 - percent) // (100 + percent)]
            for b in at.tolist():
                if trees.of[a] != trees.of[b] and alike(sets[a], sets[b], percent):
                    trees.join(a, b)
                    out.append(sorted((h[a], h[b])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(links, "a long, b long")


def components(signatures: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, sketches: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """(h, comp) of the nodes that are linked to others.

    `signatures` has (sig, h); `sets_of` gives (h, s: the sorted set, 64-bit values as bytes) for a table of nodes (h). Large
    sets should come with `sketches` (h, n: size, p: parity sketch, w: wide one), a table: then sets are made only for pairs that
    these don't rule out. Small ones are made once for all that share a signature.
    """
    with scratch(signatures.sparkSession) as keep:
        return keep(_components(signatures, sets_of, percent, sketches, rounds))


def _components(signatures: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, sketches: DataFrame | None, rounds: int) -> DataFrame:
    with large_batches(signatures.sparkSession):
        members = written(shared_lists(signatures), "lists")  # without the hubs themselves
    nodes = members.select("h").union(members.select("hub")).distinct()
    sets = wide = None
    if sketches is None:
        sets = written(sets_of(nodes), "sets")
        sketches = sets.mapInArrow(_sketched, "h long, n int, p binary")
    else:
        sketches = sketches.join(nodes, "h", "left_semi").dropDuplicates(["h"])
    sketches = written(sketches, "sketches")
    if sets is None:
        wide = sketches.where("length(w) > 0").select("h", "n", "w")

    def sets_at(ends: DataFrame) -> DataFrame:
        return written(sets_of(ends), "sets") if sets is None else sets.join(sendable(written(ends, "ends")), "h", "left_semi")

    def links(pairs: DataFrame) -> DataFrame:
        left = written(possible(pairs, sketches, percent), "pairs")
        if wide is not None:
            left = written(closer(left, wide, percent), "pairs")
        ends = left.select(F.col("a").alias("h")).union(left.select("b")).distinct()
        return written(verified(left, sets_at(ends), percent), "links")

    edges = links(members.select(F.col("hub").alias("a"), F.col("h").alias("b")).distinct())
    comps = written(connected(edges), "comps")

    # hubs have been compared with all of their lists
    left = members.select("sig", "h")
    for k in range(1, rounds + 1):
        left = left.join(comps, "h", "left").select("sig", "h", F.coalesce("comp", "h").alias("comp"))
        open_ = left.groupBy("sig").agg(
            F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min_by("h", F.xxhash64("h", F.lit(k))).alias("hub"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("_members"), F.count("*").alias("_n")
        ).where("_lo <> _hi")
        open_ = open_.groupBy("_members", "_n").agg(F.min_by(F.struct("sig", "hub"), "sig").alias("one")).select("one.*")  # lists of the same members: one of them
        left = written(left.join(open_, "sig").select("sig", "h", "comp", "hub"), "open")
        if k == rounds or not left.limit(1).count():
            break
        more = left.join(comps.select(F.col("h").alias("hub"), F.col("comp").alias("_of")), "hub", "left").where(F.coalesce("_of", "hub") != F.col("comp"))
        new = links(more.where("h <> hub").select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct())
        left = left.where("h <> hub").select("sig", "h")
        if new.limit(1).count():
            edges = edges.union(new)
            comps = written(connected(edges), "comps")
    if not left.limit(1).count():
        return comps
    trees = written(_block_pairs(left.select("sig", "h", "comp").join(sketches, "h"), percent, forest=True), "trees")
    if not trees.limit(1).count():
        return comps
    clusters = written(connected(trees).withColumnRenamed("comp", "cluster"), "clusters")
    named = clusters.join(comps, "h", "left").select("h", "cluster", F.coalesce("comp", "h").alias("comp"))
    new = written(block_links(named.join(sets_at(clusters.select("h")), "h"), percent), "links")
    return written(connected(edges.union(new)), "comps") if new.limit(1).count() else comps
