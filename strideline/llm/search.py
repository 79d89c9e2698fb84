"""Ranked lexical search with pair-bound MaxScore over an inverted index of blocks.

A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); in a document of n terms with m = 50 + 50nN div L it adds its impact
w * (10^9 tf div (1000 tf + 20 m)). N, L and df count all documents.

1. Documents become blocks of at most BLOCK documents; a block holds, for each term that any query has, the documents
   with it and how often. Counts of blocks are added up for N, L and df.
2. With these, every block gets its impacts, the maximum of each term and, for pairs of terms that queries join, the pair's
   intersection list with the greatest sum of both impacts in one document of it. A query's terms are paired in the order of
   their weights, so that maxima of like size meet: a pair adds at most max(joint maximum, larger single maximum), often far
   less than both maxima, above all if no document has both.
3. A query meets a block with the k-th best score known so far. Pairs of least bounds whose bounds together stay below it are
   not essential: documents that hold nothing else are never looked at, and the whole block is skipped if all its bounds stay
   below. Candidates from the essential lists are dropped as soon as their score and what the rest could add, by the
   intersection lists they are in, stay below.
4. A task carries its best documents from block to block; first bounds come from SEEDS blocks, whose k-th best score
   can't be above the final one. Each task returns at most k rows a query, ranked by a window.

All bounds are exact integers and only what lies strictly below is skipped, so the result is that of scoring everything.
Queries are taken in blocks of about QUERIES, each with a pass of its own, so what is sent to tasks has a bound.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lowered. Edge cases: null
and empty texts and those without a term match nothing and don't count for N; rows of a null doc_id take no part; repeated
rows are documents of their own; equal scores are ordered by doc_id; a query without terms or matches gives no rows;
items with one item_id are ranked one by one; only doc_id and text, item_id and text are read, so other columns' names
can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut
from .lm import expand, squeeze

#: Documents of a block, and occurrences of queries' terms after which it is closed.
BLOCK, OCCURRENCES = 1 << 15, 1 << 22
#: Queries of a pass; blocks that give the first bounds.
QUERIES, SEEDS = 4096, 4
TOP = 50
COUNTED = "block long, n_docs long, n_terms long, doc_ids binary, lengths binary, terms binary, starts binary, places binary, tfs binary"
IMPACTS = "block long, doc_ids binary, terms binary, starts binary, places binary, impacts binary, maxima binary, pairs binary, joint binary, shared_starts binary, shared binary"
FOUND = "query int, doc_id long, score long"
#: Bytes to those that terms are made of: letters lowered, the rest of ASCII a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of counted documents, with the postings of the vocabulary's terms."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        get, block = vocabulary.get, TaskContext.get().partitionId() << 32
        ids, lengths, found, n_docs, n_terms = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            places = np.repeat(np.arange(len(found)), [len(f) for f in found])
            keys, tfs = np.unique(flat << 32 | places, return_counts=True)
            terms, starts = np.unique(keys >> 32, return_index=True)
            columns = [np.array(ids, np.int64), np.array(lengths, np.int64), terms.astype(np.int32), np.append(starts, len(keys)).astype(np.int64), (keys & 0xFFFFFFFF).astype(np.int32), tfs.astype(np.int32)]
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (block, n_docs, n_terms)], *[pa.array([squeeze(c)], pa.binary()) for c in columns]], names=[c.split()[0] for c in COUNTED.split(", ")])

        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words = terms_of(text.as_py())
                n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                known = [t for t in map(get, words) if t is not None]
                if known:
                    ids.append(doc_id)
                    lengths.append(len(words))
                    found.append(np.array(known, np.int64))
                    size += len(known)
                if len(ids) >= BLOCK or size >= OCCURRENCES:
                    yield flush()
                    block += 1
                    ids, lengths, found, n_docs, n_terms, size = [], [], [], 0, 0, 0
        if n_docs:
            yield flush()

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, COUNTED)


def frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df = np.zeros(size, np.int64)
        for b in batches:
            for terms, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist()):
                df[expand(terms, np.int32)] += np.diff(expand(starts, np.int64))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in blocks.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Weights of terms; 0 for one that no document has."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)


def units(queries: list[list[int]], weight: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each query's terms in pairs of like weight; a last one alone is paired with -1. Terms of no weight are left out."""
    out = []
    for terms in queries:
        order = sorted((t for t in set(terms) if weight[t] > 0), key=lambda t: (-weight[t], t))
        out.append([(a, b) for a, b in zip(order[::2], [*order[1::2], -1])])
    return out


class Block:
    """A block's lists, looked up by term and by pair."""

    def __init__(self, row: dict):
        get = lambda name, kind: expand(row[name], kind)
        self.doc_ids, self.terms, self.starts = get("doc_ids", np.int64), get("terms", np.int32), get("starts", np.int64)
        self.places, self.impacts, maxima = get("places", np.int32), get("impacts", np.int64), get("maxima", np.int64)
        self.at = {t: i for i, t in enumerate(self.terms.tolist())}
        self.most = dict(zip(self.at, maxima.tolist()))
        pairs, joint, starts, shared = get("pairs", np.int32).reshape(-1, 2), get("joint", np.int64), get("shared_starts", np.int64), get("shared", np.int32)
        self.pairs = {p: (j, shared[a:b]) for p, j, a, b in zip(map(tuple, pairs.tolist()), joint.tolist(), starts[:-1].tolist(), starts[1:].tolist())}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.at[term]
        return self.places[self.starts[i] : self.starts[i + 1]], self.impacts[self.starts[i] : self.starts[i + 1]]


def impacts(blocks: DataFrame, n: int, total: int, weight: np.ndarray, pairs: list[tuple[int, int]]) -> DataFrame:
    """The blocks with impacts, maxima and the pairs' intersection lists."""
    by_first: dict[int, list[int]] = {}
    for a, b in pairs:
        by_first.setdefault(a, []).append(b)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                lengths, terms, starts = expand(row["lengths"], np.int64), expand(row["terms"], np.int32), expand(row["starts"], np.int64)
                places, tfs = expand(row["places"], np.int32), expand(row["tfs"], np.int32).astype(np.int64)
                m = 50 + 50 * lengths * n // total
                impact = np.repeat(weight[terms], np.diff(starts)) * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[places]))
                maxima = np.maximum.reduceat(impact, starts[:-1]) if len(terms) else impact
                at = {t: i for i, t in enumerate(terms.tolist())}
                part = lambda t: slice(starts[at[t]], starts[at[t] + 1])
                met, joint, shared, sizes = [], [], [], [0]
                for a in at:
                    for b in by_first.get(a, ()):
                        if b in at:
                            both, x, y = np.intersect1d(places[part(a)], places[part(b)], assume_unique=True, return_indices=True)
                            met += [a, b]
                            joint.append(int((impact[part(a)][x] + impact[part(b)][y]).max(initial=0)))
                            shared.append(both)
                            sizes.append(sizes[-1] + len(both))
                columns = [impact, maxima, np.array(met, np.int32), np.array(joint, np.int64), np.array(sizes, np.int64), np.concatenate([*shared, np.zeros(0, np.int32)]).astype(np.int32)]
                kept = [pa.array([row[c]]) for c in ("block", "doc_ids", "terms", "starts", "places")]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([squeeze(c)], pa.binary()) for c in columns]], names=[c.split()[0] for c in IMPACTS.split(", ")])

    return blocks.mapInArrow(run, IMPACTS)


def best(doc_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, by falling score, then doc_id."""
    order = np.lexsort((doc_ids, -scores))[:k]
    return doc_ids[order], scores[order]


def search_block(block: Block, pairs: list[tuple[int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a block's documents whose score is positive and at least floor, for one query."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = []  # (bound, terms, larger single maximum, joint maximum, intersection)
    for a, b in pairs:
        own = [t for t in (a, b) if t in block.at]
        if own:
            single = max(block.most[t] for t in own)
            joint, shared = block.pairs.get((a, b), (0, None)) if len(own) == 2 else (0, None)
            lists.append((max(single, joint), own, single, joint, shared))
    lists.sort(key=lambda u: u[0])
    bounds = np.cumsum([0, *(u[0] for u in lists)])
    if bounds[-1] < max(floor, 1):
        return none
    # The first so many lists can't lift a document to the floor by themselves.
    skipped = max(0, int(np.searchsorted(bounds, floor)) - 1)
    scores = np.zeros(len(block.doc_ids), np.int64)
    for _, own, *_ in lists[skipped:]:
        for t in own:
            places, impact = block.postings(t)
            scores[places] += impact
    rest = np.full(len(scores), sum(u[2] for u in lists[:skipped]))
    for _, _, single, joint, shared in lists[:skipped]:
        if shared is not None and joint > single:
            rest[shared] += joint - single
    left = np.flatnonzero(scores)
    got, rest = scores[left], rest[left]
    for _, own, single, joint, shared in reversed(lists[:skipped]):
        keep = got + rest >= floor
        left, got, rest = left[keep], got[keep], rest[keep]
        if not len(left):
            return none
        rest = rest - single
        if shared is not None and joint > single:
            rest = rest - np.where(np.isin(left, shared, assume_unique=True), joint - single, 0)
        for t in own:
            places, impact = block.postings(t)
            i = np.minimum(np.searchsorted(places, left), len(places) - 1)
            got = got + np.where(places[i] == left, impact[i], 0)
    keep = got >= max(floor, 1)
    return left[keep], got[keep]


def meet(table: DataFrame, pairs: list[list[tuple[int, int]]], floors: list[int], k: int) -> DataFrame:
    """The best documents of each query in each task's blocks, none below the query's floor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(pairs)
        floor = list(floors)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for q, own in enumerate(pairs):
                    places, scores = search_block(block, own, floor[q])
                    if len(places):
                        held[q] = best(np.concatenate([held[q][0], block.doc_ids[places]]), np.concatenate([held[q][1], scores]), k)
                        if len(held[q][0]) == k:
                            floor[q] = max(floor[q], int(held[q][1][-1]))
        for q, (ids, scores) in enumerate(held):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids), pa.array(scores)], names=["query", "doc_id", "score"])

    return table.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_some(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """The k best documents of each of items, (item_id, text): a bounded list of queries."""
    spark = docs.sparkSession
    texts = [sorted(set(terms_of(text))) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in texts for t in ts}))}
    counted = cut(index(docs, vocabulary))
    sums = counted.agg(F.count("*").alias("blocks"), F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).collect()[0]
    n, total = sums["n"] or 0, sums["total"] or 0
    weight = weights(frequencies(counted, len(vocabulary)), n)
    pairs = units([[vocabulary[t] for t in ts] for ts in texts], weight)
    table = cut(impacts(counted, n, max(total, 1), weight, sorted({p for ps in pairs for p in ps if p[1] >= 0})))
    floors = [1] * len(pairs)
    if sums["blocks"] > 4 * SEEDS:
        seeds = [r["block"] for r in table.select("block").orderBy(F.xxhash64("block")).limit(SEEDS).collect()]
        # Any k documents' worst score is at most the k-th best of all.
        for r in ranked(meet(table.filter(F.col("block").isin(seeds)), pairs, floors, k), k).filter(F.col("rank") == k).collect():
            floors[r["query"]] = r["score"]
    names = spark.createDataFrame([(q, item_id) for q, (item_id, _) in enumerate(items)], "query int, item_id long")
    return ranked(meet(table, pairs, floors, k), k).join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item. docs: doc_id, text; items: item_id, text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, math.ceil(items.count() / QUERIES))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    parts = [search_some(docs, sorted(((r["item_id"], r["text"]) for r in items.filter(of == p).collect()), key=str), k) for p in range(passes)]
    return reduce(DataFrame.union, parts)
