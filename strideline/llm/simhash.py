"""SimHash near duplicates found with vantage-point trees.

A fingerprint has a bit for each bit that is set in over half of the XXH64 hashes (seed 42) of a text's four-word
shingles. Texts whose fingerprints differ in at most REACH bits are linked; a component is what links connect.

1. Equal fingerprints meet first, with their smallest doc_id; from here on each fingerprint is one row.
2. The 64 bits are three blocks. Two linked fingerprints differ in at most one bit of some block (else they would
   differ in six or more), so each block has a tree of its own, searched with reach 1 by the Hamming distance of the block's
   bits. That distance obeys the triangle inequality, as the one of all bits does.
3. A node of a tree is a vantage point and a radius: fingerprints within it go one way, the others the other way. What
   lies nearer to the radius than the reach can have a neighbour on both sides; any other branch is pruned. Points that a
   block's bits can't part are parted by all bits with reach REACH.
4. The upper part of each tree, fitted on a sample of at most about SAMPLE fingerprints, deals all of them to shards. A
   fingerprint lives in one shard of each tree and is a visitor in the shards beyond its boundaries, of which those of lower
   number are enough, as each pair needs to meet once.
5. Each shard goes on with a tree of its own points down to leaves, where all 64 bits are compared, and returns a forest:
   links between points that it hadn't connected yet, never all pairs of a group.
6. Forests together give the components.

The sample only shapes the trees; every fingerprint is dealt and the result is exact.

Words are runs between ASCII white space, A to Z lowered; a text of fewer than four words is one shingle; a null or empty
text has fingerprint zero and is linked like any other. Edge cases: rows of a null doc_id have a fingerprint, but no
component, and link nothing; rows with one doc_id are told apart by their texts, each with its own component; repeated rows
stay; only doc_id and text are read, so other columns' names can't clash; an empty table gives no rows. Texts are
hashed in slices, so a very long one needs no more memory than its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .neardup import components

SHINGLE, SEED, REACH = 4, 42, 4
#: Bits of the blocks, and how many of them may differ in the block where a linked pair differs least.
MASKS, BLOCK_REACH = tuple(((1 << b) - 1) << a for a, b in ((0, 22), (22, 21), (43, 21))), 1
FULL = (1 << 64) - 1
#: Fingerprints that a shard should hold; bounds of the shards of a tree and of the sample that shapes it.
SHARD, MOST_SHARDS, SAMPLE = 4096, 1 << 15, 1 << 18
#: Points of a leaf; vantage points that are tried; points they are tried on; hashes and comparisons made at once.
LEAF, TRIED, TRIED_ON, AT_ONCE = 128, 8, 1024, 1 << 16


def fingerprint(text: str | None) -> int:
    import xxhash

    whole = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not whole:
        return 0
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(whole)]])
    n = max(1, len(starts) - SHINGLE + 1)
    ends = ends[-n:]
    hash_, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        some = [hash_(whole[a:b], SEED) for a, b in zip(starts[i : min(n, i + AT_ONCE)].tolist(), ends[i : i + AT_ONCE].tolist())]
        ones += np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask))


def split(points: np.ndarray, block: int, rng: np.random.Generator) -> tuple[int, int, int, int] | None:
    """The vantage point, mask, reach and radius that leave the least to compare on both sides; None if no split helps."""
    some = points if len(points) <= TRIED_ON else points[rng.integers(0, len(points), TRIED_ON)]
    n = len(some)
    for mask, reach in ((MASKS[block], BLOCK_REACH), (FULL, REACH)):
        best, least = None, 0.98 * n * n
        for v in some[rng.integers(0, n, TRIED)].tolist():
            within = np.cumsum(np.bincount(distance(some, v, mask), minlength=65))
            r = np.flatnonzero((within >= n / 16) & (within <= n - n / 16))
            if not len(r):
                continue
            inside, near, far = within[r], within[np.minimum(r + reach, 64)], n - np.where(r >= reach, within[r - reach], 0)
            work = inside * near + (n - inside) * far
            if work.min() < least:
                best, least = (v, mask, reach, int(r[work.argmin()])), work.min()
        if best:
            return best
    return None


class Tree:
    """The upper part of a block's tree: nodes as lists of (vantage, mask, reach, radius, inner, outer); a leaf is a negative number."""

    def __init__(self, sample: np.ndarray, block: int, shards: int):
        self.nodes: list[tuple] = []
        self.leaves = 0
        rng = np.random.default_rng(block)
        self.root = self._grow(sample, block, max(2, -(-len(sample) // shards)), rng)

    def _grow(self, points: np.ndarray, block: int, most: int, rng: np.random.Generator) -> int:
        found = split(points, block, rng) if len(points) > most else None
        if found is None:
            self.leaves += 1
            return -self.leaves
        inner = distance(points, found[0], found[1]) <= found[3]
        if inner.all() or not inner.any():
            self.leaves += 1
            return -self.leaves
        self.nodes.append(())
        me = len(self.nodes) - 1
        self.nodes[me] = (*found, self._grow(points[inner], block, most, rng), self._grow(points[~inner], block, most, rng))
        return me

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, place in points, and whether it lives there, of every point at home and every visitor of a leaf below its own."""
        home = np.zeros(len(points), np.int64)
        reached, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, lives = todo.pop()
            if not len(at):
                continue
            if node < 0:
                home[at[lives]] = -node
                reached.append((-node, at, lives))
                continue
            vantage, mask, reach, radius, inner, outer = self.nodes[node]
            d = distance(points[at], vantage, mask).astype(np.int64)
            a, b = d <= radius + reach, d > radius - reach
            todo += [(inner, at[a], lives[a] & (d[a] <= radius)), (outer, at[b], lives[b] & (d[b] > radius))]
        out = [(leaf, at[keep], lives[keep]) for leaf, at, lives in reached for keep in [lives | (home[at] > leaf)]]
        return np.concatenate([np.full(len(at), leaf) for leaf, at, _ in out]), np.concatenate([at for _, at, _ in out]), np.concatenate([x for _, _, x in out])


def forest(points: np.ndarray, lives: np.ndarray, block: int) -> list[tuple[int, int]]:
    """Links (places of points) that connect what is linked within a shard: among those who live there, and they with visitors."""
    parent, links = np.arange(len(points)), []
    rng = np.random.default_rng(block)

    def roots(at: np.ndarray) -> np.ndarray:
        r = parent[at]
        while True:
            above = parent[r]
            if (above == r).all():
                parent[at] = r
                return r
            r = above

    def compare(own: np.ndarray, others: np.ndarray) -> None:
        for i in range(0, len(own), LEAF):
            some = own[i : i + LEAF]
            for j in range(0, len(others), AT_ONCE // LEAF * 8):
                near = others[j : j + AT_ONCE // LEAF * 8]
                # A point is its own neighbour in one stretch of the others only, so it is told apart by its place.
                hits = (np.bitwise_count(points[some][:, None] ^ points[near][None, :]) <= REACH) & (some[:, None] != near[None, :])
                for k in np.flatnonzero(hits.any(1)):
                    found = near[hits[k]]
                    theirs, first = np.unique(roots(found), return_index=True)
                    mine = int(roots(some[k : k + 1])[0])
                    for root, q in zip(theirs.tolist(), found[first].tolist()):
                        if root != mine:
                            parent[root] = mine
                            links.append((int(some[k]), q))

    todo = [(np.flatnonzero(lives), np.arange(len(points)))]
    while todo:
        own, others = todo.pop()
        if not len(own) or not len(others):
            continue
        found = split(points[own], block, rng) if len(own) > LEAF else None
        if found is None:
            compare(own, others)
            continue
        vantage, mask, reach, radius = found
        d, e = distance(points[own], vantage, mask).astype(np.int64), distance(points[others], vantage, mask).astype(np.int64)
        todo += [(own[d <= radius], others[e <= radius + reach]), (own[d > radius], others[e > radius - reach])]
    return links


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of linked fingerprints, enough of them to connect all that is linked. prints: fingerprint, each once."""
    n = prints.count()
    shards = min(MOST_SHARDS, -(-n // SHARD))
    share = min(1.0, min(SAMPLE, max(SHARD, 32 * shards)) / max(n, 1))
    sampled = prints.filter(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("fingerprint")
    sample = np.sort(np.array([r[0] for r in sampled.collect()], np.int64).view(np.uint64))
    if not len(sample):
        sample = np.zeros(1, np.uint64)
    trees = [Tree(sample, block, max(1, shards)) for block in range(len(MASKS))]

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            points = b.column("fingerprint").to_numpy().view(np.uint64)
            for block, tree in enumerate(trees):
                leaf, at, lives = tree.route(points)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * len(MASKS) + block), b.column("fingerprint").take(pa.array(at)), pa.array(lives)], names=["shard", "fingerprint", "lives"])

    def search(key, table):
        import pyarrow as pa

        found = forest(table.column("fingerprint").to_numpy().view(np.uint64), table.column("lives").to_numpy(), key[0].as_py() % len(MASKS))
        values = table.column("fingerprint").to_numpy()
        return pa.table({name: pa.array(values[[f[side] for f in found]] if found else [], pa.int64()) for side, name in enumerate("ab")})

    dealt = prints.select("fingerprint").mapInArrow(deal, "shard long, fingerprint long, lives boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id, one row for each row of docs."""
    found = cut(describe(docs))
    prints = cut(found.filter("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    label = components(links(prints))
    joined = cut(prints.join(label, prints["fingerprint"] == label["node"], "left").select("fingerprint", "id", F.coalesce("label", "fingerprint").alias("label")))
    smallest = joined.groupBy("label").agg(F.min("id").alias("component_id"))
    named = joined.join(smallest, "label").select("fingerprint", "component_id")
    out = found.join(named, "fingerprint", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
