"""Nearest neighbours by inner product: an inverted file whose lists are scanned dimension by dimension.

Vectors are dealt to bands of norm, each reaching from half of its largest norm to it. Divided by that and given one
more component, which fills their length up to 1 (0 for queries, whose own length is 1), all of them lie on one sphere:
the largest inner product is the smallest distance. A seeded random rotation then spreads a distance evenly, so the
first b of D components hold about b/D of it.

Lists are cells of two levels, fitted on a bounded sample: centres, and offsets from centres that all cells share, so
the number of lists grows with the square root of the vectors' beyond what the sample could fit alone. A query probes
the lists of largest expected inner product. Within a list, components are read in column blocks: a candidate is abandoned
as soon as the hypothesis that it is among the nearest fails,

    partial > limit * b/D * (1 + EPSILON * sqrt((1 - b/D) / b))^2

with limit the squared distance that belongs to the k-th largest inner product known: first that within the sample,
then that of the lists read before. The number of probes is fitted: a bounded sample of queries is held against all
vectors, in blocks, and the smallest number that reaches TARGET recall on it is taken.

Distances only drop candidates that can't be among the nearest, with room for rounding; what stays is scored on the original
vectors, component by component in double precision as the result shows it, before any is cut. So equal scores are equal, and
ties, however many, go to the smaller vec_id.

How it runs. Lists are put together in shards of bounded size, a longer one is dealt to several. A query goes once to
each shard that holds lists it probes, so its vector travels once a shard, not once a list, and a shard returns at most
K + 1 rows a query. A shard that more than QUERIES queries ask meets them in several tasks, and only such a shard is sent
more than once. Equal vectors are searched once: of the rows with one vector only the K + 1 smallest ids can be
among K nearest. What is collected is bounded: the sample, the checked queries' neighbours, and a row for each list and shard.

Work. A query touches its probed lists' vectors, the fitted share of all. Vectors that form groups need few probes; of
vectors spread evenly in many dimensions no partition keeps neighbours together, and the share is above one half.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors of another number
of components than most, take no part as queries or candidates; ties go to the smaller vec_id; of rows with one
vec_id one counts, that of smallest hash; with fewer than K candidates all are returned; columns other than vec_id and
embedding aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

K, SAMPLE, CHECKED = 20, 8192, 128
#: Centres and offsets at most; their product bounds the lists.
LEVEL = 512
#: Vectors in a shard, at least and at most, shards aimed at between, and queries that meet a shard in one task.
SHARD, SHARDS, QUERIES = (1024, 65536), 64, 8192
EPSILON, BLOCK, TARGET, SEED = 2.1, 16, 0.96, 11
ROUNDS = 8
#: Pairs whose partial distances are held at once.
TILE = 1 << 21
#: How far rounding can move a product of two vectors of length 1 at most: some 1e-13 for a thousand components.
MARGIN = 1e-10


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def log_norm(v: Column, most: Column) -> Column:
    """log2 of the length; components are divided by the largest first, so nothing overflows."""
    return F.log2(most) + F.log2(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))) / 2


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def k_means(sample: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        own = nearest(sample, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


class Index:
    """The fitted part, bounded by LEVEL and the dimension: rotation, log2 of the largest norm, centres and offsets."""

    def __init__(self, dims: int, log_most: float):
        self.turn, self.log_most = rotation(dims + 1), log_most
        self.centres = self.offsets = np.zeros((1, dims + 1))

    def fit(self, sample: np.ndarray, lists: int) -> None:
        x, _ = self.data(sample)
        level = int(np.clip(round(lists**0.5), 1, min(LEVEL, max(1, len(x) // 4))))
        self.centres = k_means(x, level)
        self.offsets = k_means(x - self.centres[nearest(x, self.centres)], level)

    def _unit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of length 1, and log2 of their lengths."""
        most = np.abs(x).max(axis=1, keepdims=True)
        x = x / most
        length = np.sqrt((x**2).sum(axis=1))
        return x / length[:, None], np.log2(most[:, 0]) + np.log2(length)

    def data(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated points of the sphere, and bands: 0 for the largest norms, one more for each halving."""
        unit, log = self._unit(x)
        behind = np.maximum(self.log_most - log, 0)
        band = np.floor(behind)
        unit = unit * np.exp2(band - behind)[:, None]
        extra = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
        return np.hstack([unit, extra[:, None]]) @ self.turn, band.astype(np.int64)

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self._unit(x)[0], np.zeros((len(x), 1))]) @ self.turn

    def lists(self, x: np.ndarray, band: np.ndarray) -> np.ndarray:
        centre = nearest(x, self.centres)
        cell = centre * len(self.offsets) + nearest(x - self.centres[centre], self.offsets)
        return band * (len(self.centres) * len(self.offsets)) + cell

    def expected(self, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """For each query and list the inner product with the list's centre on the sphere, scaled by its band."""
        band, cell = np.divmod(lists, len(self.centres) * len(self.offsets))
        i, j = np.divmod(cell, len(self.offsets))
        centre = self.centres[i] + self.offsets[j]
        length = np.sqrt(np.maximum((centre**2).sum(axis=1), 1e-300))
        return (q @ (centre / length[:, None]).T) * np.exp2(-band.astype(float))


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, block: int = BLOCK, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and x of the pairs within q's limits of squared distance, and their squared distances, with early abandoning."""
    dims = x.shape[1]
    found = []
    step = max(1, TILE // max(1, len(q)))
    for first in range(0, len(x), step):
        part = x[first : first + step]
        a, b, far = None, None, np.zeros((len(q), len(part)))
        for at in range(0, dims, block):
            to = min(at + block, dims)
            bound = limit if to == dims else limit * (to / dims) * (1 + epsilon * np.sqrt((1 - to / dims) / to)) ** 2
            if a is None:
                u, v = q[:, at:to], part[:, at:to]
                far = far + (u**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None] - 2 * (u @ v.T)
                stays = far <= bound[:, None]
                # Whole matrices while most pairs stay, single pairs afterwards.
                if to == dims or np.count_nonzero(stays) * 4 < stays.size:
                    a, b = np.nonzero(stays)
                    far = far[a, b]
            else:
                far = far + ((q[a, at:to] - part[b, at:to]) ** 2).sum(axis=1)
                stays = far <= bound[a]
                a, b, far = a[stays], b[stays], far[stays]
            if a is not None and not len(a):
                break
        found.append((a, b + first, far))
    join = lambda i, t: np.concatenate([*(f[i] for f in found), np.zeros(0, t)]).astype(t)
    return join(0, np.int64), join(1, np.int64), join(2, np.float64)


def best_of(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k largest scores, ties to the smaller other, by owner and falling score."""
    order = np.lexsort((other, -score, owner))
    o = owner[order]
    first = np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, bool)
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    return order[rank < k]


def exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of original vectors, summed from the first component to the last."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            out += q[a, j] * x[b, j]
    return out


def largest(near: np.ndarray, q: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and exact score of each query's k best, ties to the smaller key. near: rounded scores, -inf for none."""
    if near.shape[1] > k:
        a, b = np.nonzero((near >= np.partition(near, -k, axis=1)[:, -k, None] - MARGIN) & (near > -np.inf))
    else:
        a, b = np.nonzero(near > -np.inf)
    score = exact(q, x, a, b)
    best = best_of(a, keys[b], score, k)
    return a[best], b[best], score[best]


class Pool:
    """The best candidates of a block of queries, and the k-th largest rounded inner product known for each."""

    def __init__(self, known: np.ndarray, k: int):
        self.known, self.k, self.size = known.copy(), k, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]

    def add(self, owner: np.ndarray, other: np.ndarray, score: np.ndarray, near: np.ndarray) -> None:
        self.parts.append((owner, other, score, near))
        self.size += len(owner)
        if self.size > 8 * self.k * max(1, len(self.known)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, other, score, near = (np.concatenate(x) for x in zip(*self.parts))
        keep = best_of(owner, other, score, self.k)
        owner, other, score, near = owner[keep], other[keep], score[keep], near[keep]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        full = np.diff(np.concatenate([starts, [len(owner)]])) == self.k
        if full.any():
            worst = np.minimum.reduceat(near, starts)[full]
            self.known[owner[starts[full]]] = np.maximum(self.known[owner[starts[full]]], worst)
        self.parts, self.size = [(owner, other, score, near)], 0
        return owner, other, score


def limits(known: np.ndarray, band: int) -> np.ndarray:
    """Squared distances on the band's sphere that belong to inner products; a little more, for rounding."""
    with np.errstate(over="ignore"):
        return 2 - 2 * (known - MARGIN) * np.exp2(float(min(band, 1100))) + 1e-9


def _matrix(column) -> np.ndarray:
    """A list column without nulls as a matrix."""
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64) if len(c) else np.zeros((0, 1))


def _lists(column_rows: np.ndarray):
    import pyarrow as pa

    n, d = column_rows.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * d, d, dtype=np.int32), column_rows.ravel())


class Shards:
    """Which shards a list's vectors are in: consecutive lists share one, a longer list has several of its own."""

    def __init__(self, lists: np.ndarray, sizes: np.ndarray):
        size = int(np.clip(sizes.sum() // SHARDS, *SHARD))
        self.lists, self.first, self.parts = lists, np.zeros(len(lists), np.int64), np.maximum(1, -(-sizes // size))
        at, held = 0, 0
        for i, (n, parts) in enumerate(zip(sizes.tolist(), self.parts.tolist())):
            if held and held + n > size:
                at, held = at + 1, 0
            self.first[i] = at
            if parts > 1:
                at, held = at + parts, 0
            else:
                held += n
        self.count = int((self.first + self.parts).max()) if len(lists) else 0

    def of(self, lists: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of each vector."""
        i = np.searchsorted(self.lists, lists)
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[i] + (mixed % self.parts[i].astype(np.uint64)).astype(np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """vectors: vec_id, embedding; is_query: over vec_id. Gives query_id, rank, vec_id, score."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    # One vector for each vec_id, whatever the table repeats.
    rows = rows.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # The K + 1 smallest ids of each vector. Ranking within 16 parts of a vector's rows first keeps a very common one apart.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", part).orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    w = Window.partitionBy("h1", "h2")
    few = few.withColumns({"r": F.row_number().over(w.orderBy("vec_id")), "key": F.min("vec_id").over(w)}).filter(F.col("r") <= k + 1)
    # The largest component is written too: within log_norm it would be sought again for every component.
    own = F.col("r") == 1
    copies = cut(few.select("h1", "h2", "key", "vec_id", "r", F.when(own, F.col("v")).alias("v"), F.when(own, F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")))
    single = copies.filter("r = 1").select("key", "v", "h1", "h2", "most")
    shape = single.agg(F.mode(F.size("v"), deterministic=True).alias("d"), F.count("*").alias("n")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not shape["n"]:
        return spark.createDataFrame([], out)
    single = single.filter(F.size("v") == shape["d"])
    index = Index(shape["d"], single.agg(F.max(log_norm(F.col("v"), F.col("most")))).first()[0])
    sample = single.orderBy(F.xxhash64("key")).limit(SAMPLE).select("key", "v").collect()
    sample_keys, points = np.array([r["key"] for r in sample]), np.array([r["v"] for r in sample])
    index.fit(points, round(shape["n"] ** 0.5))
    sample_x, sample_band = index.data(points)

    def assign(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(index.lists(*index.data(_matrix(b.column("v"))))), b.column("v")], names=["key", "list", "v"])

    placed = cut(single.select("key", "v").mapInArrow(assign, "key long, list long, v array<double>"))
    # Each query row finds its vector's key; a vector is searched once however many queries share it.
    asked = rows.filter(is_query).select("vec_id", "h1", "h2").distinct()
    asked = cut(asked.join(single.select("h1", "h2", "key"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "key"))
    wanted = asked.select("key").distinct()
    questions = cut(single.select("key", "v").join(wanted, "key", "left_semi"))
    sizes = np.array([tuple(r) for r in placed.groupBy("list").count().orderBy("list").collect()], np.int64).reshape(-1, 2)
    lists, shards = sizes[:, 0], Shards(sizes[:, 0], sizes[:, 1])
    probes = _probes(placed, questions, index, lists, k)

    def in_sample(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products with the sample, the query's own vector apart."""
        score = (q @ sample_x.T) * np.exp2(-sample_band.astype(float))[None]
        score[keys[:, None] == sample_keys[None]] = -np.inf
        return score

    def known(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th largest inner product within the sample."""
        return np.partition(in_sample(keys, q), -k, axis=1)[:, -k] if len(sample_keys) >= k else np.full(len(q), -np.inf)

    def seed(batches: Iterator) -> Iterator:
        """The nearest of the sample are candidates: so every query has k, if there are so many."""
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                keys, v = b.column("key").to_numpy(), _matrix(b.column("v"))
                owner, place, score = largest(in_sample(keys, index.query(v)), v, points, sample_keys, k)
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(sample_keys[place]), pa.array(score)], names=["q", "c", "s"])

    def aim(batches: Iterator) -> Iterator:
        """A row for each query and shard that holds lists it probes."""
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                keys, v = b.column("key").to_numpy(), _matrix(b.column("v"))
                q = index.query(v)
                best = known(keys, q)
                rank = np.argsort(-index.expected(q, lists), axis=1, kind="stable")[:, :probes]
                who, which = np.repeat(np.arange(len(q)), rank.shape[1]), rank.ravel()
                parts = shards.parts[which]
                who, which = np.repeat(who, parts), np.repeat(which, parts)
                shard = shards.first[which] + np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.lexsort((which, shard, who))
                who, which, shard = who[order], which[order], shard[order]
                opens = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (shard[1:] != shard[:-1])])) if len(who) else np.zeros(0, np.int64)
                ends = np.concatenate([opens, [len(who)]]).astype(np.int32)
                w = who[opens]
                yield pa.RecordBatch.from_arrays([pa.array(shard[opens]), pa.array(keys[w]), pa.array(best[w]), pa.ListArray.from_arrays(ends, lists[which]), _lists(v[w])], names=["shard", "key", "known", "lists", "v"])

    asking = cut(questions.mapInArrow(aim, "shard long, key long, known double, lists array<long>, v array<double>"))
    # Tasks in which each shard meets its queries.
    requests = np.array([tuple(r) for r in asking.groupBy("shard").count().collect()], np.int64).reshape(-1, 2)
    meetings = np.zeros(shards.count, np.int64)
    meetings[requests[:, 0]] = -(-requests[:, 1] // QUERIES)

    def deal(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows:
                shard = shards.of(b.column("list").to_numpy(), b.column("key").to_numpy())
                times = meetings[shard]
                at = np.repeat(np.arange(len(shard)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(block), *(b.column(c).take(pa.array(at)) for c in ("key", "list", "v"))], names=["shard", "block", "key", "list", "v"])

    def meet(batches: Iterator) -> Iterator:
        for b in batches:
            keys, shard = b.column("key").to_numpy(), b.column("shard").to_numpy()
            mixed = keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((mixed % meetings[shard].astype(np.uint64)).astype(np.int64))], names=[*b.schema.names, "block"])

    left = placed.mapInArrow(deal, "shard long, block long, key long, list long, v array<double>")
    right = asking.mapInArrow(meet, "shard long, key long, known double, lists array<long>, v array<double>, block long")
    cells = len(index.centres) * len(index.offsets)

    def compare(group, queries):
        pool, who = Pool(queries.column("known").to_numpy(), k + 1), queries.column("key").to_numpy()
        if group.num_rows and queries.num_rows:
            v, keys, own = _matrix(group.column("v")), group.column("key").to_numpy(), group.column("list").to_numpy()
            order = np.lexsort((keys, own))
            v, keys, own = v[order], keys[order], own[order]
            x = index.data(v)[0]
            asked_v, wanted = _matrix(queries.column("v")), queries.column("lists").combine_chunks()
            q = index.query(asked_v)
            probed, by = wanted.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
            order = np.lexsort((by, probed))
            probed, by = probed[order], by[order]
            for one in np.unique(own):
                i, j = np.searchsorted(own, [one, one + 1])
                mine = by[np.searchsorted(probed, one) : np.searchsorted(probed, one + 1)]
                if len(mine):
                    band = int(one // cells)
                    a, b, far = scan(q[mine], x[i:j], limits(pool.known[mine], band))
                    pool.add(mine[a], keys[i:j][b], exact(asked_v, v[i:j], mine[a], b), (1 - far / 2) * np.exp2(-float(band)))
        owner, other, score = pool.settle()
        return pa.table({"q": who[owner] if len(owner) else np.zeros(0, np.int64), "c": other, "s": score})

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(compare, "q long, c long, s double")
    near = near.union(questions.mapInArrow(seed, "q long, c long, s double")).groupBy("q", "c").agg(F.max("s").alias("s"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))).filter(F.col("r") <= k + 1).select("q", "c", F.col("s").alias("score"))
    rows_of = near.join(copies.select(F.col("key").alias("c"), "vec_id"), "c")
    best = rows_of.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    mine = asked.join(best, F.col("key") == F.col("q")).select("query_id", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return mine.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _probes(placed: DataFrame, questions: DataFrame, index: Index, lists: np.ndarray, k: int) -> int:
    """The fewest probes that reach TARGET recall for CHECKED queries against all vectors."""
    import pyarrow as pa

    some = questions.orderBy(F.xxhash64("key")).limit(CHECKED).collect()
    if not some:
        return 1
    v, ids = np.array([r["v"] for r in some]), np.array([r["key"] for r in some])
    q = index.query(v)

    def truth(batches: Iterator) -> Iterator:
        for b in batches:
            if b.num_rows:
                own, keys, x = b.column("list").to_numpy(), b.column("key").to_numpy(), _matrix(b.column("v"))
                turned, band = index.data(x)
                s = (q @ turned.T) * np.exp2(-band.astype(float))[None]
                s[ids[:, None] == keys[None]] = -np.inf
                owner, at, score = largest(s, v, x, keys, k)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys[at]), pa.array(own[at]), pa.array(score)], names=["q", "key", "list", "s"])

    best = placed.mapInArrow(truth, "q long, key long, list long, s double").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "key"))).filter(F.col("r") <= k)
    place = np.argsort(np.argsort(-index.expected(q, lists), axis=1, kind="stable"), axis=1)  # how late a query probes each list
    hits = np.array([place[r["q"], np.searchsorted(lists, r["list"])] for r in best.select("q", "list").collect()])
    return int(np.sort(hits)[max(0, int(np.ceil(TARGET * len(hits))) - 1)]) + 1 if len(hits) else 1
