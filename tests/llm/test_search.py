import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """Every document scored for every item."""
    counted = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def items_of(spark, rows_):
    return spark.createDataFrame(rows_, "item_id long, text string")


def made(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    pick = lambda k: " ".join(words[min(299, int(rng.paretovariate(0.7)) - 1)] for _ in range(k))
    docs = [(i, pick(rng.choice([1, 5, 40, 200]))) for i in range(n)]
    return docs, [(i, pick(rng.choice([1, 2, 7, 30]))) for i in range(40)]


@pytest.mark.parametrize("text", [None, "", "...", "One two-two ÉA é_x 3d\x00a\x7fb Ａ", "日本語 текст x"])
def test_terms(text):
    assert [t.decode() for t in search.terms_of(text)] == terms(text)


def test_query_equals_plain_search(spark, sf_dir):
    from strideline.llm import entry

    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert rows(entry.queries()["op12_ranked_search"](spark, sf_dir)) == plain(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_many_blocks_and_passes(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("OCCURRENCES", 2000), ("QUERIES", 15)):
        monkeypatch.setattr(search, name, value)
    docs, items = made(1500)
    got = rows(search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), items_of(spark, items), 7))
    assert got == plain(docs, items, 7)


def test_bounds_skip_and_lose_nothing(spark):
    docs, items = made(800, 9)
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, x in items for t in search.terms_of(x)}))}
    counted = search.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), vocabulary).persist()
    n, total = counted.agg(F.sum("n_docs"), F.sum("n_terms")).collect()[0]
    weight = search.weights(search.frequencies(counted, len(vocabulary)), n)
    pairs = search.units([[vocabulary[t] for t in search.terms_of(x)] for _, x in items], weight)
    table = search.impacts(counted, n, total, weight, sorted({p for ps in pairs for p in ps if p[1] >= 0}))
    block = search.Block(table.collect()[0].asDict())
    tighter = sum(max(j, max(block.most[a], block.most[b])) < block.most[a] + block.most[b] for (a, b), (j, _) in block.pairs.items())
    assert tighter > len(block.pairs) / 3
    for (a, b), (joint, shared) in block.pairs.items():
        x, y = (dict(zip(*map(np.ndarray.tolist, block.postings(t)))) for t in (a, b))
        assert sorted(x.keys() & y.keys()) == shared.tolist() and joint == max((x[d] + y[d] for d in shared.tolist()), default=0)
    for own in pairs:
        places, scores = search.search_block(block, own, 1)
        for floor in (np.sort(scores)[-3:].tolist() if len(scores) else []) + [10**12]:
            p, s = search.search_block(block, own, floor)
            want = dict(zip(places[scores >= floor].tolist(), scores[scores >= floor].tolist()))
            assert dict(zip(p.tolist(), s.tolist())) == want


def test_edges(spark, docs):
    texts = [None, "", "!!", "tie word", "tie word", "no id word", "word " * 50_000, "x" * 300_000, "tie word", "other"]
    ids = [1, 2, 3, 9, 4, None, 6, 7, 4, 8]
    items = [(1, "word tie"), (1, "Other"), (2, None), (3, "?"), (4, "absent"), (5, "x" * 300_000)]
    df = docs(texts, ids=ids).withColumns({c: F.lit("mine") for c in ("block", "query", "rank", "score", "terms")})
    got = rows(search.search(df, items_of(spark, items).withColumn("query", F.lit("mine"))))
    assert got == plain(list(zip(ids, texts)), items)
    assert rows(search.search(docs([]), items_of(spark, items))) == []
    assert rows(search.search(df, items_of(spark, []))) == []
