"""Secret scans: keyword automaton, anchored patterns, checksums.

One Aho-Corasick pass over the case-folded text finds keywords: names of credentials, token prefixes, and all groups
of four hexadecimal digits, one of which opens every run of digits. Only at such a hit is the kind's pattern tried,
anchored there. Tokens with an embedded checksum (the CRC-32 in base 62 that closes GitHub and npm tokens) must validate; a JWT,
which has none, is validated by its header, which must be JSON with an algorithm. Matches of a kind are leftmost and don't overlap; starts and ends are code points.

Edge cases: a null text is empty and has no spans; texts are scanned whole; folding touches A-Z only where lower()
would change lengths; repeated rows are scanned one by one; columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: In the order that breaks ties of spans with one start.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
#: The patterns of the contract and of public token formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
_UPPER = {c: c + 32 for c in range(65, 91)}

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def checksum(payload: str) -> str:
    """CRC-32 of payload as six digits of base 62."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _sums(m: re.Match) -> bool:
    return checksum(m[1]) == m[2]


def _jwt(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= MIN_ASSIGN),
    "access": (ACCESS, lambda m: m.end() - m.start() >= MIN_ACCESS),
    "hex": (HEX, lambda m: m.end() - m.start() >= MIN_HEX),
    "github": (GITHUB, _sums),
    "npm": (NPM, _sums),
    "jwt": (JWT, _jwt),
}

_automaton = None


def automaton():
    """Built once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        for digits in itertools.product("0123456789abcdef", repeat=4):
            a.add_word("".join(digits), ("hex", 4))
        a.make_automaton()
        _automaton = a
    return _automaton


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every secret, sorted."""
    folded = text.lower()
    if len(folded) != len(text):
        folded = text.translate(_UPPER)
    over, out = dict.fromkeys(RULES, 0), []
    for last, (kind, n) in automaton().iter(folded):
        start = last - n + 1
        if start < over[kind]:
            continue
        pattern, holds = RULES[kind]
        if m := pattern.match(text, start):
            over[kind] = m.end()
            if holds(m):
                out.append((start, KINDS.index(kind), m.end()))
    return sorted(out)


def _scan(batches: Iterator, redact: bool) -> Iterator:
    import pyarrow as pa

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        texts = b.column("text").to_pylist()
        found = [find(t) if t else [] for t in texts]
        cols = dict(zip(b.schema.names, b.columns))
        if redact:
            cols["text"] = pa.array([masked(t, f) if f else t for t, f in zip(texts, found)], pa.string())
        else:
            cols["secrets"] = pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found], span)
            del cols["text"]
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with every span, overlapping ones merged, replaced by [KIND] of the first."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and secrets: array of (kind, start, end), for each row of docs."""
    keep = [c for c in keep if c not in ("text", "secrets")]
    df = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    schema = T.StructType([f for f in df.schema if f.name != "text"] + [T.StructField("secrets", SPANS)])
    return df.mapInArrow(lambda bs: _scan(bs, False), schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced by their kind, and n_chars, where docs has it, counted anew."""
    df = docs.mapInArrow(lambda bs: _scan(bs, True), docs.schema)
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else df


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
