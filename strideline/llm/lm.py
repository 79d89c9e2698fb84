"""Language-model scores by deleted interpolation.

A bigram model mixes three estimates: the maximum-likelihood bigram and unigram and a uniform floor. The weights
depend on the bucket of the context's frequency (powers of two) and are learned by expectation-maximisation on counts
of a part of the training documents that was deleted from the estimates meanwhile; then all training documents count.

How it runs. Documents become blocks of about BLOCK tokens: a sorted vocabulary of 64-bit hashes and a stream of places
in it, written to the shared folder. A block asks for the counts of its distinct words and bigrams; requests are dealt
to buckets by the highest bits of the key, with the block's own counts. A bucket adds up equal keys and answers every
request with the totals in the request's order. So a key's rows are one a block, however common it is, whole columns
of numbers travel instead of rows, and no vocabulary is broadcast. EM needs for each token only its context's bucket
and the ratios of the three estimates; these are gathered over all deleted documents in a histogram of log-ratios of
fixed size, on which the driver iterates.

Limit: every block asks every bucket that holds one of its keys, so there are up to blocks times buckets rows, which grow as
the square of the tokens until a row holds about one key; from then on they grow with the keys. At BLOCK and BUCKET tokens that
is reached near 10**12 tokens; larger corpora want a larger BLOCK, as far as a task's memory goes.

Edge cases: a null or empty text is its end token alone; a null doc_id is a training document; rows with one doc_id are
scored one by one; without training documents N and V are 0; only doc_id and text are read, so other columns' names can't
clash; an empty table gives no rows. Context of the first token is the text's beginning, which is no token.

Error of EM's histogram: a ratio is rounded to the nearest of STEPS steps a doubling, so by at most a factor of
2**(1/16), 4.4 %; it moves the weights only, scores use the exact estimates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

BLOCK, BUCKET = 1 << 20, 1 << 21
#: Of crc32(doc_id as text) modulo 7: 2 is held out from training, 3 is deleted from the estimates for EM.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
CONTEXT_BUCKETS, STEPS, ITERATIONS, FLOOR = 24, 8, 60, 1e-7

BLOCKS = "block long, part int, n_tokens long, doc_ids array<long>, lengths binary, vocab binary, stream binary"
REQUESTS = "bucket int, block long, part int, kind int, keys binary, counts binary"
ANSWERS = "block long, bucket int, kind int, kept binary, deleted binary, v_kept long, v_all long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ESTIMATED, DELETED_PART, HELD_OUT_PART = 0, 1, 2
WORDS, BIGRAMS, SIZES = 0, 1, 2


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes; the length comes first."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    import zstandard

    n, dtype = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    raw = zstandard.ZstdDecompressor().decompress(data[8:]) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def marks() -> tuple[int, int]:
    """Hashes of the text's beginning and end; no word holds a space."""
    return word_hash(b" begin"), word_hash(b" end")


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key for each pair of 64-bit keys."""
    with np.errstate(over="ignore"):
        k = a * np.uint64(0x9E3779B97F4A7C15) + b
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """ASCII white space divides words; A to Z become lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Open:
    """A block that is being filled."""

    def __init__(self):
        self.places, self.docs, self.lengths, self.streams, self.n = _Places(), [], [], [], 0

    def add(self, doc: int | None, words: list[bytes]) -> None:
        self.streams.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc)
        self.lengths.append(len(words) + 1)
        self.n += len(words) + 1

    def row(self, number: int, part: int) -> tuple:
        """The vocabulary is sorted by hash and holds both marks; the stream has each text's words and its end."""
        begin, end = marks()
        hashes = np.array([*map(word_hash, self.places), begin, end], np.uint64)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(hashes), np.uint32)
        place[order] = np.arange(len(hashes), dtype=np.uint32)
        closing = np.array([len(hashes) - 1], np.uint32)
        stream = place[np.concatenate([x for s in self.streams for x in (s, closing)])]
        return number, part, self.n, self.docs, squeeze(np.array(self.lengths, np.uint32)), squeeze_sorted(hashes[order]), squeeze(stream)


def make_blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        held = {p: _Open() for p in (ESTIMATED, DELETED_PART, HELD_OUT_PART)}

        def close(part: int):
            nonlocal made
            row = held[part].row(first + made, part)
            held[part], made = _Open(), made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for doc, text, fold in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "fold"))):
                part = HELD_OUT_PART if fold == HELD_OUT else DELETED_PART if fold == DELETED else ESTIMATED
                held[part].add(doc, words_of(text))
                if held[part].n >= BLOCK:
                    yield close(part)
        for part in held:
            if held[part].n:
                yield close(part)

    fold: Column = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.cast("int").alias("fold")).mapInArrow(run, BLOCKS)


class Block:
    """A block as read back: for each token the places of its word and context, and its bigram among the sorted ones."""

    def __init__(self, lengths: bytes, vocab: bytes, stream: bytes):
        self.lengths = expand(lengths, np.uint32).astype(np.int64)
        self.vocab = expand_sorted(vocab)
        self.word = expand(stream, np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.begin = np.searchsorted(self.vocab, np.uint64(marks()[0]))
        self.context = np.concatenate([[self.begin], self.word[:-1]]).astype(np.uint32)
        self.context[self.starts] = self.begin
        self.bigrams, self.bigram, self.bigram_counts = np.unique(mix(self.vocab[self.context], self.vocab[self.word]), return_inverse=True, return_counts=True)

    def word_counts(self) -> np.ndarray:
        """Of each vocabulary entry; the beginning counts once a text."""
        n = np.bincount(self.word, minlength=len(self.vocab))
        n[self.begin] = len(self.lengths)
        return n


def requests(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in REQUESTS.split(", ")]
        for b in batches:
            for number, part, lengths, vocab, stream in zip(*(b.column(c).to_pylist() for c in ("block", "part", "lengths", "vocab", "stream"))):
                block, rows = Block(lengths, vocab, stream), []
                for kind, keys, counts in ((WORDS, block.vocab, block.word_counts()), (BIGRAMS, block.bigrams, block.bigram_counts)):
                    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]])
                    for i, j in zip(edges, edges[1:]):
                        rows.append((int(bucket[i]), number, part, kind, squeeze_sorted(keys[i:j]), squeeze(counts[i:j].astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return blocks.select("block", "part", "lengths", "vocab", "stream").mapInArrow(run, REQUESTS)


def answers(asked: DataFrame) -> DataFrame:
    """For each request the totals of its keys, over the documents kept for estimates and over the deleted; a row of kind SIZES has the bucket's numbers of distinct tokens."""

    def run(table):
        import pyarrow as pa

        rows, begin = [], np.uint64(marks()[0])
        cols = {c: table.column(c).to_pylist() for c in ("bucket", "block", "part", "kind", "keys", "counts")}
        for kind in (WORDS, BIGRAMS):
            mine = [i for i, k in enumerate(cols["kind"]) if k == kind]
            if not mine:
                continue
            keys = [expand_sorted(cols["keys"][i]) for i in mine]
            counts = [expand(cols["counts"][i], np.uint64) for i in mine]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            edges = np.cumsum([0, *map(len, keys)])
            totals = np.zeros((2, len(distinct)), np.uint64)
            for i, a, b, n in zip(mine, edges, edges[1:], counts):
                if cols["part"][i] != HELD_OUT_PART:
                    totals[cols["part"][i]][place[a:b]] += n  # a request's keys are distinct
            for i, a, b in zip(mine, edges, edges[1:]):
                rows.append((cols["block"][i], cols["bucket"][i], kind, squeeze(totals[0][place[a:b]]), squeeze(totals[1][place[a:b]]), None, None))
            if kind == WORDS:
                token = distinct != begin
                rows.append((None, cols["bucket"][0], SIZES, None, None, int((token & (totals[0] > 0)).sum()), int((token & (totals.sum(axis=0) > 0)).sum())))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ANSWERS.split(", ")])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


class Counted:
    """A block with its answers: for each token the counts of its bigram, context and word."""

    def __init__(self, blocks, answered, deleted_too: bool):
        self.block = Block(*(blocks.column(c)[0].as_py() for c in ("lengths", "vocab", "stream")))
        got: dict[int, list[tuple]] = {WORDS: [], BIGRAMS: []}
        for bucket, kind, kept, deleted in zip(*(answered.column(c).to_pylist() for c in ("bucket", "kind", "kept", "deleted"))):
            n = expand(kept, np.uint64)
            got[kind].append((bucket, n + expand(deleted, np.uint64) if deleted_too else n))
        # Buckets are ranges of keys, so answers in their order are in the keys' order.
        words, bigrams = (np.concatenate([n for _, n in sorted(got[k], key=lambda x: x[0])]).astype(np.float64) for k in (WORDS, BIGRAMS))
        self.bigram, self.context, self.word = bigrams[self.block.bigram], words[self.block.context], words[self.block.word]

    def estimates(self, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Context's bucket, and the bigram, unigram and uniform probabilities."""
        two = np.divide(self.bigram, self.context, out=np.zeros_like(self.bigram), where=self.context > 0)
        return context_bucket(self.context), two, self.word / max(n, 1), 1 / (v + 1)


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(c + 1)).astype(np.int64), CONTEXT_BUCKETS - 1)


def em(histogram: np.ndarray) -> np.ndarray:
    """(CONTEXT_BUCKETS, 3): weights of bigram, unigram and uniform. histogram: rows of bucket, step of bigram, step of unigram, tokens.

    A bucket without deleted tokens takes the weights of the next lower one."""
    weights, before = np.zeros((CONTEXT_BUCKETS, 3)), np.array([0.0, 0.5, 0.5])
    level = lambda s: np.where(s == 0, 0.0, 2.0 ** ((s - 1) / STEPS))
    for b in range(CONTEXT_BUCKETS):
        rows = histogram[histogram[:, 0] == b] if len(histogram) else histogram
        if len(rows):
            p = np.stack([level(rows[:, 1]), level(rows[:, 2]), np.ones(len(rows))], axis=1)
            w = np.full(3, 1 / 3)
            for _ in range(ITERATIONS):
                share = p * w
                w = (share / share.sum(axis=1, keepdims=True) * rows[:, 3:4]).sum(axis=0)
                w = w / w.sum()
            w = np.maximum(w, [0, 0, FLOOR])
            before = w / w.sum()
        weights[b] = before
    return weights


def ratio_steps(p: np.ndarray, floor: float) -> np.ndarray:
    """0 for none, else 1 + log2(p / floor) in STEPS a doubling. A probability above 0 below the floor is step 1."""
    r = np.zeros(len(p), np.int64)
    some = p > 0
    r[some] = 1 + np.maximum(np.rint(STEPS * np.log2(p[some] / floor)), 0).astype(np.int64)
    return r


def gather(blocks: DataFrame, answered: DataFrame, n: int, v: int) -> DataFrame:
    def run(block, answer):
        import pyarrow as pa

        if not block.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "two", "one", "tokens")})
        bucket, two, one, floor = Counted(block, answer, False).estimates(n, v)
        rows, tokens = np.unique(np.stack([bucket, ratio_steps(two, floor), ratio_steps(one, floor)]), axis=1, return_counts=True)
        return pa.table({"bucket": rows[0], "two": rows[1], "one": rows[2], "tokens": tokens.astype(np.int64)})

    mine = blocks.filter(F.col("part") == DELETED_PART)
    theirs = answered.join(mine.select("block"), "block", "left_semi")
    found = mine.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(run, "bucket long, two long, one long, tokens long")
    return found.groupBy("bucket", "two", "one").agg(F.sum("tokens").alias("tokens"))


def score_blocks(blocks: DataFrame, answered: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(block, answer):
        import pyarrow as pa

        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        counted = Counted(block, answer, True)
        bucket, two, one, floor = counted.estimates(n, v)
        w = weights[bucket]
        model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * floor)
        base = np.log10((counted.word + 1) / (n + 1 * (v + 1)))
        at = counted.block.starts
        docs = block.column("doc_ids")[0].as_py()
        known = np.add.reduceat((counted.word > 0).astype(np.int64), at)
        columns = (docs, [block.column("part")[0].as_py() == HELD_OUT_PART] * len(docs), counted.block.lengths, known, [n] * len(docs), np.add.reduceat(base, at), np.add.reduceat(model, at))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, RESULT)


def score(docs: DataFrame) -> DataFrame:
    """A row of RESULT for each row of docs, trained on those outside fold HELD_OUT."""
    blocks = cut(make_blocks(docs))
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"), *[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n_tokens"))), F.lit(0)).alias(f"n{p}") for p in (ESTIMATED, DELETED_PART)]).first()
    bits = max(0, int(size["all"] // BUCKET).bit_length())
    answered = cut(answers(requests(blocks, bits)))
    distinct = answered.filter(F.col("kind") == SIZES).agg(F.coalesce(F.sum("v_kept"), F.lit(0)).alias("kept"), F.coalesce(F.sum("v_all"), F.lit(0)).alias("all")).first()
    counts = answered.filter(F.col("kind") != SIZES).select("block", "bucket", "kind", "kept", "deleted")
    found = gather(blocks, counts, size[f"n{ESTIMATED}"], distinct["kept"]).collect()  # at most CONTEXT_BUCKETS x steps x steps rows
    weights = em(np.array([tuple(r) for r in found], dtype=np.float64).reshape(-1, 4))
    return score_blocks(blocks, counts, weights, size[f"n{ESTIMATED}"] + size[f"n{DELETED_PART}"], distinct["all"])
