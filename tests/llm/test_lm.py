import math
import zlib
from collections import Counter

import numpy as np

from strideline.llm import lm

TEXTS = [None, "", "The cat sat", "the CAT sat on the mat", "É a\x0bb\xa0c", *[f"the {a} sat on the {b} and the {a} ran" for a in ("cat", "dog", "cow") for b in ("mat", "hat", "bat", "rat")] * 6, "new words only here", "word " * 3000]


def tokens(t):
    return [*(t or "").encode().lower().split(), b" end"]


def expected(ids):
    c = Counter()
    for i, t in zip(ids, TEXTS):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    return c, sum(c.values()), len(c)


def test_base_scores_and_counts(docs, monkeypatch):
    for block, bucket in ((lm.BLOCK, lm.BUCKET), (40, 16)):
        monkeypatch.setattr(lm, "BLOCK", block)
        monkeypatch.setattr(lm, "BUCKET", bucket)
        ids = [*range(len(TEXTS) - 1), 3]
        rows = lm.score(docs(TEXTS, ids=ids)).collect()
        assert len(rows) == len(TEXTS)
        c, n, v = expected(ids)
        want = sorted((i, zlib.crc32(str(i).encode()) % 7 == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in zip(ids, TEXTS))
        assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_blocks_do_not_change_the_model(docs, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in lm.score(docs(TEXTS)).collect()}
    monkeypatch.setattr(lm, "BLOCK", 30)
    monkeypatch.setattr(lm, "BUCKET", 8)
    parts = {r["doc_id"]: r["score"] for r in lm.score(docs(TEXTS)).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-6 * (1 + abs(whole[k])) for k in whole)


def test_model_beats_add_one_on_held_out_text(docs):
    rows = [r for r in lm.score(docs(TEXTS)).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_model_equals_brute_force(docs):
    """Scores from plain dictionaries, with the weights learned from a plain histogram."""
    ids = list(range(len(TEXTS)))
    part = {i: zlib.crc32(str(i).encode()) % 7 for i in ids}
    uni, bi, ctx = {"a": Counter(), "all": Counter()}, {"a": Counter(), "all": Counter()}, {"a": Counter(), "all": Counter()}
    for i, t in zip(ids, TEXTS):
        w = tokens(t)
        for name in ["all"] * (part[i] != 2) + ["a"] * (part[i] not in (2, 3)):
            uni[name].update(w)
            bi[name].update(zip([b" begin", *w], w))
            ctx[name].update([b" begin", *w[:-1]])
    ctx["a"][b" begin"], ctx["all"][b" begin"] = (sum(part[i] not in bad for i in ids) for bad in ((2, 3), (2,)))

    def ps(name, h, w):
        n, v = sum(uni[name].values()), len(uni[name])
        c = ctx[name][h] if h == b" begin" else uni[name][h]
        return min(int(math.floor(math.log2(c + 1))), lm.CONTEXT_BUCKETS - 1), bi[name][h, w] / c if c else 0.0, uni[name][w] / n, 1 / (v + 1)

    hist = Counter()
    for i, t in zip(ids, TEXTS):
        if part[i] == 3:
            w = tokens(t)
            for h, x in zip([b" begin", *w], w):
                b, two, one, floor = ps("a", h, x)
                hist[b, *lm.ratio_steps(np.array([two, one]), floor).tolist()] += 1
    weights = lm.em(np.array([(*k, n) for k, n in sorted(hist.items())], dtype=float).reshape(-1, 4))
    got = {r["doc_id"]: r["score"] for r in lm.score(docs(TEXTS)).collect()}
    for i, t in zip(ids, TEXTS):
        w, total = tokens(t), 0.0
        for h, x in zip([b" begin", *w], w):
            b, two, one, floor = ps("all", h, x)
            total += math.log10(weights[b] @ [two, one, floor])
        assert abs(total - got[i]) < 1e-6 * (1 + abs(total))


def test_em_finds_the_better_estimate():
    # Tokens that the bigram predicts far better than the unigram, and the other way round.
    steps = lambda p, floor: int(lm.ratio_steps(np.array([p]), floor)[0])
    h = np.array([[3, steps(0.5, 1e-3), steps(0.01, 1e-3), 90], [5, 0, steps(0.2, 1e-3), 50]], dtype=float)
    w = lm.em(h)
    assert w[3, 0] > 0.9 and w[5, 1] > 0.9 and np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all()


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(5, dtype=np.uint32)):
        assert (lm.expand(lm.squeeze(a), a.dtype) == a).all()
    keys = np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))
    assert (lm.expand_sorted(lm.squeeze_sorted(keys)) == keys).all()


def test_empty_and_untrained(docs):
    assert lm.score(docs([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(docs(["a b"], ids=[held])).collect()[0]
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"])
