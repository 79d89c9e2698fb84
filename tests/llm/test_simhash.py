import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strideline.llm import simhash


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(prints):
    """Smallest index of each fingerprint's component, by comparing all pairs."""
    p = np.array(prints, np.uint64)
    label = np.arange(len(p))
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 4
    while True:
        new = np.where(near, label[None, :], len(p)).min(1)
        if (new == label).all():
            return label
        label = new


def scattered(n, seed=1):
    """Fingerprints at random, around centres, and in chains of few bits."""
    rng = random.Random(seed)
    out = {0, 1 << 3, (1 << 64) - 1}
    while len(out) < n:
        centre = rng.getrandbits(64)
        out.add(centre)
        for _ in range(rng.choice([0, 0, 3, 30])):
            x = centre
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            centre = rng.choice([centre, x])
    return sorted(out)


def united(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, "One", "one two THREE", "a b c d", "é É a B c\td\x0be f", "the same words again " * 50, " ".join(map(str, range(200_000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_equals_sparks_hash(spark):
    text = "four words of text"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).collect()[0][0] == np.uint64(simhash.fingerprint(text)).astype(np.int64)


def test_trees_and_shards_lose_no_link():
    points = np.array(scattered(6000), np.uint64)
    want = connected(points)
    found = []
    for block in range(3):
        tree = simhash.Tree(points[::7], block, 24)
        assert tree.leaves > 8
        leaf, at, lives = tree.route(points)
        assert np.bincount(at[lives], minlength=len(points)).tolist() == [1] * len(points)
        assert len(at) < 8 * len(points)
        for one in np.unique(leaf):
            own = leaf == one
            links = simhash.forest(points[at[own]], lives[own], block)
            assert len(links) < own.sum()
            found += [(int(at[own][a]), int(at[own][b])) for a, b in links]
    assert all(int(points[a] ^ points[b]).bit_count() <= 4 for a, b in found)
    assert united(len(points), found) == want.tolist()


def test_a_crowd_around_one_fingerprint_is_parted_and_linked_by_a_forest():
    """Many fingerprints that share a block's bits: the tree goes on with all bits, and links stay fewer than points."""
    rng = random.Random(4)
    points = np.array(sorted({sum(1 << b for b in rng.sample(range(22, 64), rng.randrange(1, 30))) for _ in range(3000)} | {1 << i | 1 << j for i in range(22, 64) for j in range(22, i)}), np.uint64)
    tree = simhash.Tree(points, 0, 12)
    assert tree.leaves > 3
    links = simhash.forest(points, np.ones(len(points), bool), 0)
    assert len(links) < len(points)
    assert united(len(points), links) == connected(points).tolist()


def test_a_link_to_a_visitor_far_from_the_point_itself_is_found():
    """A leaf with more others than are compared at once: the point and its only neighbour are in different stretches."""
    rng = random.Random(6)
    far = [rng.getrandbits(64) for _ in range(10_000)]
    points = np.array([5, *far, 4], np.uint64)
    lives = np.zeros(len(points), bool)
    lives[0] = True
    assert simhash.forest(points, lives, 0) == [(0, len(points) - 1)]


def test_query_equals_all_pairs(spark, sf_dir):
    from strideline.llm import entry

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.queries()["op13_simhash"](spark, sf_dir).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    prints = [plain(t) for _, t in rows]
    label = connected(prints)
    assert got == {d: (f"{p:016x}", rows[k][0]) for (d, _), p, k in zip(rows, prints, label)}


def test_many_shards_in_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 128)
    points = scattered(3000, seed=8)
    want = connected(points)
    signed = [int(np.uint64(p).astype(np.int64)) for p in points]
    prints = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(5)
    place = {p: i for i, p in enumerate(signed)}
    found = [(place[r["a"]], place[r["b"]]) for r in simhash.links(prints).collect()]
    assert united(len(points), found) == want.tolist()


def test_edges(spark, docs):
    df = docs([None, "", "a b c d e", "A b c d e", "no id", "other text of five", "a b c d e"], ids=[9, 4, 7, 6, None, 6, 7])
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes(df).collect()), key=str)
    p = lambda t: f"{plain(t):016x}"
    assert got == sorted([(9, "0" * 16, 4), (4, "0" * 16, 4), (7, p("a b c d e"), 6), (6, p("a b c d e"), 6), (None, p("no id"), None), (6, p("other text of five"), 6), (7, p("a b c d e"), 6)], key=str)
    clash = docs(["x", "x"]).withColumns({c: F.lit("mine") for c in ("fingerprint", "id", "node", "label", "component_id", "shard")})
    assert [r["component_id"] for r in simhash.classes(clash).collect()] == [0, 0]
    assert simhash.classes(docs([])).collect() == []
