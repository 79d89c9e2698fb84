"""Ids of whole texts by the tokenizers library, and documents dealt to tasks in order of doc_id."""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .pieces import ID, PieceMemo


def alphabet() -> np.ndarray:
    """The character by which byte-level vocabularies show each byte: itself if it is visible, else one from 256 on."""
    shown = np.zeros(256, np.uint32)
    visible = [b for first, last in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(first, last + 1)]
    shown[visible] = visible
    hidden = np.setdiff1d(np.arange(256), visible)
    shown[hidden] = 256 + np.arange(len(hidden))
    return shown


class Encoder:
    """encode(texts): an array of ids for each text, as the library makes them without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        first = self.library.pre_tokenizer and json.loads(self.library.pre_tokenizer.__getstate__())
        if not first or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level vocabulary with its usual pattern")
        added = {t.content: (i, t) for i, t in self.library.get_added_tokens_decoder().items() if t.content}
        if self.library.normalizer is not None or any(t.single_word or t.lstrip or t.rstrip for _, t in added.values()):
            raise ValueError(f"{path}: a normalizer, or added tokens that take more or less than their string")
        self.marks = {x: np.array([i], dtype=ID) for x, (i, _) in added.items()}
        # The library takes the leftmost string, and the longest of those.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.model, self.shown = self.library.model, alphabet()
        self.memo = PieceMemo(self._encode_pieces)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece by the library's model, in the alphabet in which its merges are written."""
        shown = self.shown[np.frombuffer(b"".join(pieces), np.uint8)].astype("<u4").tobytes().decode("utf-32-le")
        tokenize, id_of, flat, ends, at = self.model.tokenize, attrgetter("id"), [], [], 0
        for n in map(len, pieces):
            flat.extend(map(id_of, tokenize(shown[at : at + n])))
            ends.append(ID.itemsize * len(flat))
            at += n
        raw = np.array(flat, dtype=ID).tobytes()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Strings of added tokens are ids of their own; what lies between them is cut into pieces."""
        if self.split is None:
            yield from self.memo.encode(texts)
            return
        marks: deque[list[str]] = deque()

        def between():
            for text in texts:
                found = self.split(text)
                marks.append(found[1::2])
                yield from found[::2]

        made = self.memo.encode(between())
        for ids in made:
            own = marks.popleft()
            yield np.concatenate([ids, *(x for m in own for x in (self.marks[m], next(made)))]) if own else ids

    def sentence_ends(self) -> np.ndarray:
        """For each id whether a sentence or line may end with it. A line feed is shown as the byte-level alphabet shows it."""
        n = self.library.get_vocab_size(with_added_tokens=True)
        shown = (self.library.id_to_token(i) or "" for i in range(n))
        return np.array([t.endswith((".", "!", "?")) or "Ċ" in t for t in shown], dtype=bool)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges of doc_id, sorted: one shuffle of the raw texts, before anything is made of them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def encoded(batches, path: str, end: int, at_once: int = 1024):
    """(doc_id, ids with the end id) of each row, in order."""
    e = encoder(path)
    tail = np.array([end], dtype=ID)
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            part = b.slice(at, at_once)
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), e.encode(texts)):
                yield doc, np.concatenate([ids, tail])
