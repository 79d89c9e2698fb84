"""Order-preserving packing by dynamic programming.

Documents, in order of doc_id, form a stream of tokens that is cut into windows of at most LENGTH tokens. Cuts lie at
document ends (free), at sentence ends (SENTENCE_PENALTY), and inside a sentence only if it is longer than a window.
The cuts minimise padding plus penalties: with f the least cost of the stream up to a cut at token p,

    f(p) = penalty(p) + OPEN + min of f(q) + LENGTH - (p - q) over cuts q with p - q <= LENGTH,

so a monotone queue of f(q) + q answers each minimum in constant amortised time; windows of a power of two of tokens
need no padding and are tried beside it. The stream is dealt to tasks by ranges of doc_id; a task packs it in
segments of SEGMENT tokens, carrying the last window over, so its memory doesn't grow with its share.

Edge cases: a null or empty text is its end id alone; rows with one doc_id are packed one after the other, ordered by
text, by one task; a null doc_id comes first; only doc_id and text are read, so other columns' names can't clash; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import ids as tokens

LENGTH, END_ID = 2048, 1
SENTENCE_PENALTY, INSIDE_PENALTY, OPEN = 24, 96, 8
SEGMENT = 1 << 19
#: Shorter windows aren't made for the sake of their power of two.
POWERS = (1024, 512, 256)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, may_end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts, from 0 to len(ids), and their penalties."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int64)
    penalty[1:][may_end[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[[0, len(ids)]] = 0
    at = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(at) > length)
    if len(wide):
        inner = np.concatenate([np.arange(at[i] + length, at[i + 1], length) for i in wide])
        penalty[inner] = INSIDE_PENALTY
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """The chosen places, from the first to the last of at."""
    best, back = [0] * len(at), [0] * len(at)
    place = {p: i for i, p in enumerate(at)}
    queue: deque[int] = deque([0])  # indices with rising best + place
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        cost, source = best[i] + length - (p - at[i]), i
        for power in POWERS:
            k = place.get(p - power)
            if k is not None and best[k] < cost:
                cost, source = best[k], k
        best[j], back[j] = cost + penalty[j] + OPEN, source
        key = best[j] + p
        while queue and best[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        chosen.append(at[j])
    return chosen[::-1]


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], may_end: np.ndarray, first_id: int, segment: int = SEGMENT) -> Iterator[list[tuple]]:
    """Rows of SCHEMA, a list for each segment. docs: (doc_id, ids) in order."""
    held: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, ids of it that are packed, the rest, all its ids
    size, sequence = 0, first_id

    def flush(last: bool) -> list[tuple]:
        nonlocal held, size, sequence
        ids = np.concatenate([h[2] for h in held])
        ends = np.cumsum([len(h[2]) for h in held])
        cuts = best_cuts(*(x.tolist() for x in cut_points(ids, ends, may_end)))
        if not last and len(cuts) > 2:
            cuts.pop()
        rows, d, begin = [], 0, 0
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                doc, done, rest, n = held[d]
                to = min(b, begin + len(rest))
                rows.append((doc, done + at - begin, to - at, zlib.crc32(ids[at:to].tobytes()), n, sequence, at - a))
                if to == begin + len(rest):
                    d, begin = d + 1, to
                at = to
            sequence += 1
        held = [(h[0], h[1] + max(0, cuts[-1] - s), h[2][max(0, cuts[-1] - s) :], h[3]) for h, s in zip(held[d:], np.cumsum([begin, *(len(h[2]) for h in held[d:])]).tolist())]
        size = len(ids) - cuts[-1]
        return rows

    for doc, ids in docs:
        held.append((doc, 0, ids, len(ids)))
        size += len(ids)
        if size >= segment:
            yield flush(False)
    while held:
        yield flush(True)


def pack(docs: DataFrame, path: str, end: int = END_ID) -> DataFrame:
    """One row of SCHEMA for each piece. sequence_id: the task's range of doc_id times 2**36 plus a running number."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 36
        may_end = tokens.encoder(path).sentence_ends()
        for rows in pack_stream(tokens.encoded(batches, path, end), may_end, first):
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return tokens.in_order(docs).mapInArrow(run, SCHEMA)
