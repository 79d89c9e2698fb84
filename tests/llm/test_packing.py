import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from strideline.llm import ids, packing
from strideline.llm.entry import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def cost_of(cuts, penalty, length):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        n = b - a
        total += packing.OPEN + penalty[b] + (0 if n in packing.POWERS else length - n)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=25), st.data())
def test_cuts_cost_as_little_as_any(gaps, data):
    at = [0, *np.cumsum(gaps).tolist()]
    penalty = [0, *data.draw(st.lists(st.sampled_from([0, 24, 96]), min_size=len(gaps), max_size=len(gaps)))]
    best = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + packing.OPEN + penalty[j] + (0 if at[j] - at[i] in packing.POWERS else 2048 - (at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 2048)
    cuts = packing.best_cuts(at, penalty)
    assert cuts[0] == 0 and cuts[-1] == at[-1] and all(b - a <= 2048 for a, b in zip(cuts, cuts[1:]))
    assert cost_of(cuts, dict(zip(at, penalty)), 2048) == best[-1]


def test_cut_points_lie_at_ends_and_inside_long_sentences():
    may_end = np.zeros(10, bool)
    may_end[7] = True
    tokens = np.array([1] * 50 + [7] + [1] * 5000 + [1], np.uint32)
    at, penalty = packing.cut_points(tokens, np.array([len(tokens)]), may_end)
    assert at.tolist() == [0, 51, 51 + 2048, 51 + 4096, len(tokens)]
    assert penalty.tolist() == [0, packing.SENTENCE_PENALTY, packing.INSIDE_PENALTY, packing.INSIDE_PENALTY, 0]


@pytest.mark.parametrize("segment", [3000, 1 << 19])
def test_stream_keeps_every_token_in_order(segment):
    rng = np.random.default_rng(4)
    docs = [(i, rng.integers(0, 50, n).astype(np.uint32)) for i, n in enumerate([1, 5000, 1, 1, 300, 20000, 2047, 2048, 2049, *rng.integers(1, 900, 60)])]
    rows = [r for rows in packing.pack_stream(iter(docs), np.arange(50) == 3, 10, segment) for r in rows]
    at, seen, last = {}, dict.fromkeys(range(len(docs)), 0), (0, 0)
    for doc, start, n, crc, total, sequence, offset in rows:
        tokens = docs[doc][1]
        assert start == seen[doc] and total == len(tokens) and crc == zlib.crc32(tokens[start : start + n].tobytes()) and n > 0
        seen[doc] += n
        assert offset == at.get(sequence, 0) and (doc, start) >= last
        at[sequence], last = offset + n, (doc, start)
    assert all(seen[i] == len(t) for i, t in docs) and max(at.values()) <= 2048
    assert sorted(at) == list(range(10, 10 + len(at)))


def test_pack_whole_table(docs):
    texts = [None, "", "A sentence. Another one!\nA line", "x" * 5000, *[f"Words of document {i}. " * (i % 90) for i in range(150)]]
    df = docs(texts, ids=[*range(153), 7])
    rows = packing.pack(df, PATH).collect()
    want = {}
    for i, t in zip([*range(153), 7], texts):
        want.setdefault(i, []).append(len(list(ids.encoder(PATH).encode([t or ""]))[0]) + 1)
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: sum(n) for i, n in want.items()}
    size = {}
    for r in rows:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 2048
    assert packing.pack(docs([]), PATH).count() == 0
