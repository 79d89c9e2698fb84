"""Near duplicates by order MinHash and banded alignment.

Two documents are linked if, aligned in order, they share at least THRESHOLD of their words: g / (n + m - g) >= 0.8
with g the longest common subsequence of their words, and at least ORDER five-word shingles, or all words. A class is a
connected component of links; equal texts are linked.

1. Equal texts meet by digest; one document stands for them.
2. Each sketch of a text takes the ORDER smallest of its occurrence-labelled five-word shingles under a seeded hash and
   keeps them in the order of the text. Texts with an equal sketch are candidates. Texts whose shingles have similarity s
   agree in one sketch with probability about s**ORDER, so SKETCHES of them miss a pair with probability
   (1 - s**ORDER)**SKETCHES: 0.02 for s = 0.4, which is one word in ten edited, and under 1e-6 for s = 0.7.
3. In each bucket of equal sketches every text is verified against the smallest id (a star, not all pairs).
4. Verified links give components. Buckets that still hold several components are searched exactly: within parts of
   bounded size an inverted index of the rarest words (prefix filter, lossless at THRESHOLD) finds the pairs left to
   verify. A large bucket is dealt to classes of length, so wide that texts which can be similar are in one class or in
   neighbouring ones, and each class to parts; only parts of one or neighbouring classes meet. So no link is lost, no task
   holds more than two parts, and a text is sent once for each part of its own length.
5. Components of all links are the classes; class_id is the smallest doc_id.

Words are runs between ASCII white space, A to Z lowered; a text of fewer than five words is one shingle, a text
without words none, so it equals only itself. Edge cases: null texts are alone; rows with one doc_id are one document;
a null doc_id has a null class and takes no part; only doc_id and text are read, so other columns' names can't clash;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .lm import word_hash, words_of

SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, ORDER, SEED = 22, 2, 5
#: Hashes made at once.
AT_ONCE = 1 << 17
#: Texts in a part of a bucket; numbers of words remembered by a worker; rows taken from a batch at once.
PART, WORDS, ROWS = 1024, 200_000, 256
#: Parts beyond which a bucket is dealt to classes of length first: each text meets three classes, so fewer parts are cheaper alone.
FEW_PARTS = 4



class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = word_hash(word)
        return h


_hashes = _Hashes()


def word_codes(text: str | None) -> np.ndarray:
    """Hashes of the text's words in order."""
    words = words_of(text)
    if len(_hashes) > WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles in order."""
    w = word_codes(text)
    n = min(SHINGLE, len(w))
    if not n:
        return w
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles or words told apart by how often they came before."""
    order = np.argsort(s, kind="stable")
    sorted_ = s[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    if first.all():
        return s
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = s.copy()
    with np.errstate(over="ignore"):
        out[order] = sorted_ + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def _seeds() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def sketches(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One 64-bit value for each seed; none for no shingles."""
    if not len(s):
        return np.zeros(0, np.int64)
    marked, k = labelled(s), min(ORDER, len(s))
    out, step = np.empty(len(seeds), np.uint64), max(1, AT_ONCE // len(s))
    with np.errstate(over="ignore"):
        for i in range(0, len(seeds), step):
            some = seeds[i : i + step, None]
            h = (marked[None] ^ some) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(32)
            at = np.sort(np.argpartition(h, k - 1, axis=1)[:, :k], axis=1) if k < len(s) else np.broadcast_to(np.arange(k), (len(some), k))
            v = some[:, 0]
            for x in s[at].T:
                v = (v ^ x) * np.uint64(0x9E3779B97F4A7C15)
                v ^= v >> np.uint64(31)
            out[i : i + step] = v
    return out.view(np.int64)


def most_unmatched(n: int, m: int) -> int:
    """Words that a linked pair may leave unmatched."""
    return int((n + m) * (1 - 2 * THRESHOLD / (1 + THRESHOLD)) + 1e-9)


def similar(g: int, n: int, m: int) -> bool:
    return g > 0 and g >= THRESHOLD * (n + m - g) - 1e-9


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence whose matches lie within band of the diagonal: a bit vector of the band for each row."""
    places = defaultdict(list)
    for i, x in enumerate(a.tolist()):
        places[x].append(i)
    width, n = 2 * band + 1, len(a)
    top = 1 << (width - 1)
    v, found = (1 << width) - 1, 0
    none: list[int] = []
    for j, x in enumerate(b.tolist()):
        base = j - band
        mask = 0
        at = places.get(x, none)
        if at:
            for i in at if len(at) < 4 else at[bisect_left(at, base) :]:
                if base <= i <= j + band:
                    mask |= 1 << (i - base)
                elif i > j + band:
                    break
            u = v & mask
            if u:
                v = ((v + u) | (v & ~mask)) & ((1 << width) - 1)
        found += not v & 1  # the column that leaves the band is settled
        v = (v >> 1) | top
    return found + width - v.bit_count() if n else 0


def linked(a: np.ndarray, b: np.ndarray, marked_a: np.ndarray, marked_b: np.ndarray) -> bool:
    """Whether two texts' words are similar in order. Common ends are matched first; a pair whose shared words don't suffice in any order isn't aligned."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < THRESHOLD * max(n, m) - 1e-9:
        return False
    if not similar(len(np.intersect1d(marked_a, marked_b, assume_unique=True)), n, m):
        return False
    k = min(n, m)
    same = a[:k] == b[:k]
    head = k if same.all() else int(np.argmin(same))
    same = a[n - k + head :][::-1] == b[m - k + head :][::-1] if k > head else np.zeros(0, bool)
    tail = len(same) if same.all() else int(np.argmin(same))
    core_a, core_b = a[head : n - tail], b[head : m - tail]
    g = head + tail
    if len(core_a) and len(core_b):
        g += banded(core_a, core_b, most_unmatched(n, m))
    return similar(g, n, m)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, digest, number of words and sketches of each text that isn't null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seeds = _seeds()
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            made = [shingles(t) for t in b.column("text").to_pylist()]
            words = pa.array([len(x) + SHINGLE - 1 for x in made], pa.int64())  # five for fewer ones
            found = [sketches(x, seeds) for x in made]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), words, pa.ListArray.from_arrays(offsets, np.concatenate([*found, np.zeros(0, np.int64)]))], names=["doc_id", "digest", "words", "sketches"])

    df = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "text")
    return df.mapInArrow(run, "doc_id long, digest string, words long, sketches array<long>")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            keep, last = [], (None, None)
            for i, (x, y) in enumerate(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())):
                if last[0] != x:
                    s = word_codes(x)
                    last = (x, (s, labelled(s)))
                t = word_codes(y)
                if linked(last[1][0], t, last[1][1], labelled(t)):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def search_part(ids: list[int], labels: list[int], texts: list[str], sides: list[int]) -> list[tuple[int, int]]:
    """Links between different components, each component joined once. sides: 0 and 1 for two parts that meet, which are
    compared with each other only, or 2 for a part that meets itself."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    s = [word_codes(t) for t in texts]
    marked = [labelled(x) for x in s]
    if not sum(map(len, marked)):
        return []
    values, counts = np.unique(np.concatenate(marked), return_counts=True)
    index: dict[int, list[int]] = defaultdict(list)
    out = []
    for i in sorted(range(len(ids)), key=lambda i: (len(s[i]), ids[i])):
        n = len(s[i])
        if not n:
            continue
        rarest = marked[i][np.lexsort((marked[i], counts[np.searchsorted(values, marked[i])]))]
        prefix = rarest[: n - int(np.ceil(THRESHOLD * n - 1e-9)) + 1].tolist()
        seen = set()
        for x in prefix:
            for j in index[x]:
                if j not in seen and (sides[i] == 2 or sides[i] != sides[j]) and find(labels[i]) != find(labels[j]):
                    seen.add(j)
                    if linked(s[i], s[j], marked[i], marked[j]):
                        root[find(labels[i])] = find(labels[j])
                        out.append((ids[i], ids[j]))
        for x in prefix:
            index[x].append(i)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component: labels spread over edges and are then looked up once more, until none changes."""
    both = cut(edges.union(edges.select("b", "a")).toDF("a", "b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, "new", "left").select("node", "label", F.least("new", "far").alias("new")))
        label = step.select("node", F.col("new").alias("label"))
        if step.filter("label != new").isEmpty():
            return label


def deal(named: DataFrame, open_: DataFrame) -> DataFrame:
    """The meetings of each text: band, value, low and i, high and j (the classes and parts that meet), id, label, and side.

    named: band, value, id, words, label. open_: band, value and n of the buckets to be searched. A bucket of at
    most FEW_PARTS parts is one class; in larger ones texts that can be similar differ by a class at most, as a class is a little wider
    than 1 / THRESHOLD."""
    width = float(np.log(1 / THRESHOLD) * (1 + 1e-6))
    own = F.when(F.col("n") <= FEW_PARTS * PART, 0).otherwise(F.floor(F.log(F.col("words").cast("double")) / width)).cast("int")
    rows = named.join(open_, ["band", "value"]).withColumn("class", own)
    counts = rows.groupBy("band", "value", "class").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    # A few dozen classes a bucket: the logarithm of the longest text.
    sizes = counts.groupBy("band", "value").agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("parts"))
    rows = rows.join(sizes, ["band", "value"])
    of = lambda c: F.coalesce(F.try_element_at("parts", c), F.lit(0))
    part = F.pmod(F.xxhash64(F.lit(1), "id"), of(F.col("class"))).cast("int")
    rows = rows.withColumn("part", part)
    c, p = F.col("class"), F.col("part")
    none = F.array().cast("array<struct<low:int,i:int,high:int,j:int,side:int>>")

    def meet(other: Column, low: Column, i, high: Column, j, side) -> Column:
        each = lambda x: F.struct(low.alias("low"), i(x).alias("i"), high.alias("high"), j(x).alias("j"), side(x).alias("side"))
        return F.when(of(other) > 0, F.transform(F.sequence(F.lit(0), of(other) - 1), each)).otherwise(none)

    same = meet(c, c, lambda x: F.least(x, p), c, lambda x: F.greatest(x, p), lambda x: F.when(x == p, 2).when(p < x, 0).otherwise(1))
    above = meet(c + 1, c, lambda x: p, c + 1, lambda x: x, lambda x: F.lit(0))
    below = meet(c - 1, c - 1, lambda x: x, c, lambda x: p, lambda x: F.lit(1))
    return rows.select("band", "value", "id", "label", F.explode(F.concat(same, above, below)).alias("m")).select("band", "value", "m.*", "id", "label")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, one row for each row of docs."""
    found = cut(describe(docs))
    alike = found.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("words").alias("words"), F.min_by("sketches", "doc_id").alias("sketches"))
    alike = cut(alike)
    same = found.select("doc_id", "digest").join(alike.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    buckets = alike.select("id", "words", F.posexplode("sketches").alias("band", "value"))
    shared = cut(buckets.groupBy("band", "value").agg(F.min("id").alias("lead"), F.count_distinct("id").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("set")).filter("n > 1"))
    members = cut(buckets.join(shared.select("band", "value", "lead"), ["band", "value"]).distinct())
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(wanted, "doc_id", "left_semi"))
    star = members.filter("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    stars = cut(_verify(star, texts))
    label = components(stars.union(same.filter("a != b")))
    named = members.join(label, members["id"] == label["node"], "left").select("band", "value", "id", "words", F.coalesce("label", "id").alias("label"))
    # Buckets with several components left; of buckets with equal members one is enough.
    open_ = named.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("band", "value")
    open_ = open_.join(shared.select("band", "value", "n", "set"), ["band", "value"]).groupBy("n", "set").agg(F.min(F.struct("band", "value")).alias("k"))
    dealt = deal(named, open_.select("k.band", "k.value", "n")).join(texts, F.col("id") == F.col("doc_id")).drop("doc_id")

    def search(table):
        import pyarrow as pa

        pairs = search_part(*(table.column(c).to_pylist() for c in ("id", "label", "text", "side")))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    rest = cut(dealt.groupBy("band", "value", "low", "i", "high", "j").applyInArrow(search, "a long, b long"))
    if not rest.isEmpty():
        # Components are joined through their labels.
        lead = lambda c: F.coalesce(F.col(f"{c}.label"), F.col(f"rest.{c}"))
        joined = rest.alias("rest").join(label.alias("a"), F.col("rest.a") == F.col("a.node"), "left").join(label.alias("b"), F.col("rest.b") == F.col("b.node"), "left").select(lead("a").alias("a"), lead("b").alias("b")).filter("a != b")
        over = components(joined)
        lone = over.join(label, over["node"] == label["node"], "left_anti")
        label = cut(label.join(over.withColumnRenamed("label", "above"), label["label"] == over["node"], "left").select(label["node"], F.coalesce("above", label["label"]).alias("label")).union(lone.select("node", "label")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(label, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its class's smallest, one row for each; rows of null doc_id stay."""
    keep = classes(docs.filter("doc_id IS NOT NULL")).filter("doc_id = class_id").select("doc_id").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = whole.join(keep, F.col("row.doc_id").cast("long") == keep["doc_id"], "left_semi").withColumn("id", F.col("row.doc_id")).dropDuplicates(["id"])
    return first.select("row.*").unionByName(docs.filter("doc_id IS NULL"))
