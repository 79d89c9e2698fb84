"""Byte-level BPE as a lazily determinised transducer.

A sequence of tokens is what BPE makes of its bytes if and only if BPE keeps each pair of neighbours apart, so every
prefix of a piece has one last token, found from the last tokens of shorter prefixes. A position of the text is live while
some vocabulary token could start there and reach beyond the bytes read; a state of the transducer is the bytes since
the oldest live position and the last tokens at the live ones, so words with the same ending share it. Reading a byte
gives the new prefix's last token. When only the newest position is live, all tokens up to it are settled and emitted;
the delay is bounded by how long tokens can overlap. States and transitions are made when first needed.

Decoding joins the tokens' bytes in blocks and runs a UTF-8 state machine across the blocks' borders.

Edge cases: a null text is empty and has no tokens; texts are encoded whole; strings of special tokens are ordinary
text; repeated rows are encoded one by one; only doc_id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .pieces import ID, PieceMemo

MAX_STATES = 300_000
_BYTES = [bytes((b,)) for b in range(256)]
#: Bytes of a piece between two emissions.
LOOKAHEAD = 64
#: Tokens decoded at once.
BLOCK = 4096
#: Rows encoded at once.
ROWS = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class State(dict):
    """byte -> (state, last token of the new prefix), filled when first asked for.

    text: the bytes since the oldest live position. live: for each live position its place in text, and the last token
    of the prefix that ends there (-1 at the piece's start)."""

    __slots__ = ("owner", "text", "live")

    def __init__(self, owner: Transducer, text: bytes, live: tuple[tuple[int, int], ...]):
        self.owner, self.text, self.live = owner, text, live

    def __missing__(self, byte: int) -> tuple[State, int]:
        made = self[byte] = self.owner.step(self, byte)
        return made


class Transducer:
    """encode(bytes) gives the ids of one piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(len(t))}
        self.apart: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(self, b"", ((0, -1),))
        self.states: dict[tuple, State] = {(b"", self.start.live): self.start}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made a token, None for a byte: BPE of its bytes, stopped before the last merge."""
        if token not in self.made_of:
            data = self.token[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.made_of[token]

    def keeps_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is the two tokens.

        Merges of both sides happen in order of rank. Going back in time, the later of the two merges next to the border
        is undone, and the tokens that then faced each other mustn't have had a merge that came before it."""
        key, known = (left, right), self.apart.get((left, right))
        if known is not None:
            return known
        token, ranks, due, known = self.token, self.ranks, 1 << 60, None
        while known is None:
            across = ranks.get(token[left] + token[right], 1 << 60)
            a, b = self.halves(left), self.halves(right)
            if across < due:
                known = False
            elif a is None and b is None:
                known = True
            elif b is None or (a is not None and left > right):
                left, due = a[1], left
            else:
                # Of equal ranks the leftmost goes first, so the border's merge would have preceded the right side's.
                right, due = b[0], right + 1
        if len(self.apart) > MAX_STATES:
            self.apart.clear()
        self.apart[key] = known
        return known

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """The transition on a byte."""
        text, last, live = state.text + _BYTES[byte], -2, []
        for k, before in state.live:
            rest = text[k:]
            t = self.ranks.get(rest)
            if last == -2 and t is not None and (before == -1 or self.keeps_apart(before, t)):
                last = t
            if rest in self.prefixes:
                live.append((k, before))
        live.append((len(text), last))
        oldest = live[0][0]
        key = (text[oldest:], tuple([(k - oldest, t) for k, t in live]))
        new = self.states.get(key)
        if new is None:
            new = self.states[key] = State(self, *key)
        return new, last

    def encode(self, piece: bytes) -> list[int]:
        """Settled tokens are emitted after every LOOKAHEAD bytes, the others at the piece's end."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, ids, lasts = self.start, [], []
        for at in range(0, len(piece), LOOKAHEAD):
            for byte in piece[at : at + LOOKAHEAD]:
                state, last = state[byte]
                lasts.append(last)
            if at + LOOKAHEAD < len(piece) and (to := self._settled(state, lasts)):
                ids += self._tokens(lasts, to)
                del lasts[:to]
        return ids + self._tokens(lasts, len(lasts))

    def _settled(self, state: State, lasts: list[int]) -> int:
        """The last position that the encodings of all live positions have in common."""
        heads = {len(lasts) - len(state.text) + k for k, _ in state.live}
        while len(heads) > 1:
            at = max(heads)
            heads.remove(at)
            heads.add(at - self.size[lasts[at - 1]])
        return max(0, heads.pop())

    def _tokens(self, lasts: list[int], at: int) -> list[int]:
        """From the last token of each prefix, the tokens up to a position: each starts where the one before it ends."""
        size, out = self.size, []
        while at > 0:
            t = lasts[at - 1]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out


class Utf8Machine:
    """Incremental UTF-8: bytes in, the text of all characters complete so far out; a broken one becomes U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._open(data)
        self.held = data[len(data) - keep :] if keep else b""
        return (data[: len(data) - keep] if keep else data).decode("utf-8", "replace")

    @staticmethod
    def _open(data: bytes) -> int:
        """Bytes at the end that begin a character which isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            width = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            return back if width > back and Utf8Machine._may_go_on(data[-back:]) else 0
        return 0

    @staticmethod
    def _may_go_on(tail: bytes) -> bool:
        if len(tail) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
        return low <= tail[1] <= high

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder over whole texts; one in each worker for each vocabulary."""

    def __init__(self, path: str):
        self.fst = Transducer(read_ranks(path))
        self.memo = PieceMemo(self._pieces)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        made = list(map(self.fst.encode, pieces))
        packed = np.array([i for ids in made for i in ids], ID).tobytes()
        ends = list(itertools.accumulate(len(ids) * ID.itemsize for ids in made))
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return self.memo.encode(texts)

    def decode(self, ids: list[int]) -> Iterator[str]:
        """The text of ids, block by block."""
        machine = Utf8Machine()
        for i in range(0, len(ids), BLOCK):
            yield machine.feed(b"".join(map(self.fst.token.__getitem__, ids[i : i + BLOCK])))
        yield machine.close()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids: array<int>, for each row."""

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = list(c.encode(t or "" for t in part.column("text").to_pylist()))
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, np.concatenate(ids).astype(np.int32))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        for b in batches:
            texts = ["".join(c.decode(ids or [])) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each text encoded, and its ids decoded, in one pass, so that no ids are shuffled or stored."""

    def run(batches):
        import pyarrow as pa

        c = codec(path)
        decimal = [b"%d" % i for i in range(max(c.fst.token) + 1)]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                counts, id_sums, text_sums = [], [], []
                for array in c.encode(t or "" for t in part.column("text").to_pylist()):
                    ids, text = array.tolist(), hashlib.sha256()
                    for block in c.decode(ids):
                        text.update(block.encode())
                    counts.append(len(ids))
                    id_sums.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                    text_sums.append(text.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
