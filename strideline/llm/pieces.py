"""Byte-level pre-tokenization of batches of texts in numpy, and a bounded memory of what pieces encode to.

The pattern of byte-level vocabularies divides a text by classes of characters: letters, numbers, white space and
others. A piece is a run of one class, with the space before it; of white space before anything else the last character
stands apart, or joins what follows if it is a space; an apostrophe that opens a run of others takes one of a few
endings with it. All of this follows from the classes of neighbouring characters, so a batch is cut with array
operations, equal pieces are brought together by Arrow's dictionary encoding, and only distinct pieces are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

ID = np.dtype("<u4")
#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE, END = 0, 1, 2, 3, 4
#: White space as Unicode has it: the same set in every engine.
WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Ends a text in a batch: no character.
_END = 0x10FFFF + 1
#: Characters cut at once, and pieces remembered.
BATCH, ENTRIES, LONGEST = 1 << 19, 250_000, 64

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        import regex

        out = np.zeros(_END + 1, np.uint8)
        for first, last in ((0, 0xD800), (0xE000, _END)):
            every = "".join(map(chr, range(first, last)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
                for m in regex.finditer(pattern, every):
                    out[first + m.start() : first + m.end()] = kind
        out[list(WHITE)] = SPACE
        out[_END] = END
        _classes = out
    return _classes


def starts(c: np.ndarray) -> np.ndarray:
    """For each code point whether a piece starts there. c: texts, each with an _END behind it, which is its own piece."""
    kind = classes()[c]
    first = np.ones(len(c), bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == END
    # White space before another character: its last one stands apart, or goes with that character.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    first[last] = True
    joins = last[c[last] == 0x20] + 1
    first[joins] = False
    # Apostrophes with their endings, unless a space or another character of their class came before.
    marks = np.flatnonzero(c == 0x27)
    marks = marks[first[marks]]
    if len(marks):
        at = lambda i: c[np.minimum(marks + i, len(c) - 1)]
        one, two = at(1), at(2)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, width in ((short, 2), (long, 3)):
            first[marks[which] + 1] = False
            first[marks[which] + width] = True
    return first


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about BATCH characters: a space before a character that isn't white space opens a piece."""
    at = 0
    while len(text) - at > BATCH:
        cut = text.find(" ", at + BATCH)
        while cut != -1 and cut + 1 < len(text) and (text[cut + 1].isspace() or ord(text[cut + 1]) in WHITE):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def cut(texts: list[str]):
    """The pieces of a batch as an Arrow array of bytes, and the number of pieces up to each text's end. Ends are dropped."""
    import pyarrow as pa

    whole = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    c = np.full(len(whole) + len(texts), _END, np.uint32)
    body = np.ones(len(c), bool)
    body[ends] = False
    c[body] = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    first = starts(c)
    wide = np.where(body, 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF), 0)
    offsets = np.cumsum(wide) - wide
    begin = np.flatnonzero(first)
    real = body[begin]
    # An end has no bytes, so dropping its piece leaves the offsets whole.
    bounds = np.append(offsets[begin[real]], offsets[-1] + wide[-1] if len(wide) else 0).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(whole.encode())])
    return data, np.cumsum(real)[np.searchsorted(begin, ends)]


class PieceMemo:
    """encode(texts): an array of ids for each text. encode_pieces: list of bytes -> list of packed ids (of dtype ID).

    The table of known pieces starts anew beyond ENTRIES, and long pieces aren't kept, so its memory is bounded."""

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[bytes]], entries: int = ENTRIES):
        self.encode_pieces, self.entries, self.known = encode_pieces, entries, {}

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """In order, made from parts of at most about BATCH characters."""
        held: list[tuple[str, bool]] = []  # part of a text, whether it is the last
        size, parts = 0, []
        for text in texts:
            pieces = list(_slices(text))
            for i, p in enumerate(pieces):
                held.append((p, i == len(pieces) - 1))
                size += len(p) + 1
                if size >= BATCH:
                    yield from self._settle(held, parts)
                    held, size = [], 0
        if held:
            yield from self._settle(held, parts)

    def _settle(self, held: list[tuple[str, bool]], parts: list[np.ndarray]) -> Iterator[np.ndarray]:
        for ids, (_, last) in zip(self._batch([p for p, _ in held]), held, strict=True):
            parts.append(ids)
            if last:
                yield np.concatenate(parts) if len(parts) > 1 else ids
                parts.clear()

    def _batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        pieces, ends = cut(texts)
        coded = pieces.dictionary_encode()
        distinct, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > self.entries:
            self.known.clear()
        known = self.known
        got = list(map(known.get, distinct))
        need = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(need, self.encode_pieces([distinct[i] for i in need]), strict=True):
            got[i] = x
            if len(distinct[i]) <= LONGEST:
                known[distinct[i]] = x
        ids = np.frombuffer(b"".join(got), ID)
        n = np.fromiter(map(len, got), np.int64, len(got)) // ID.itemsize
        start, width = (np.cumsum(n) - n)[place], n[place]
        upto = np.cumsum(width)
        total = int(upto[-1]) if len(upto) else 0
        out = ids[np.repeat(start - (upto - width), width) + np.arange(total)]
        at = np.concatenate([[0], upto])[ends]
        for a, b in zip(np.concatenate([[0], at[:-1]]), at):
            yield out[a:b]
