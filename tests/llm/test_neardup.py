import random

import numpy as np

from strideline.llm import neardup as nd


def prose(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def corpus(seed=1):
    r, texts = random.Random(seed), []
    passage = prose(r, 60)
    for _ in range(25):
        words = prose(r, r.randrange(40, 200))
        texts.append(" ".join(words))
        for _ in range(r.randrange(4)):
            copy = list(words)
            for _ in range(r.randrange(1, 4)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(999)}"
            texts.append(" ".join(copy))
        texts += [texts[-1]] * r.randrange(3)
        texts.append(" ".join(prose(r, 20) + passage + prose(r, 20)))
    return texts + [None, None, "", "", " ", "a b", "A  b", "a b c d e", "a b c d e f"]


def expected(texts, ids):
    s = [nd.word_codes(t) for t in texts]
    k = [set(nd.shingles(t).tolist()) for t in texts]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            same = texts[i] == texts[j]
            if not same and len(s[i]) and len(s[j]) and min(len(s[i]), len(s[j])) >= 0.7 * max(len(s[i]), len(s[j])):
                same = (len(k[i] & k[j]) >= nd.ORDER or s[i].tolist() == s[j].tolist()) and nd.similar(lcs(s[i].tolist(), s[j].tolist()), len(s[i]), len(s[j]))
            if same:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(docs, by_id):
    texts = corpus()
    got = by_id(nd.classes(docs(texts)))
    assert {i: r["class_id"] for i, r in got.items()} == expected(texts, list(range(len(texts))))


def test_parts_of_large_buckets_lose_no_link(docs, by_id, monkeypatch):
    monkeypatch.setattr(nd, "PART", 2)
    texts = corpus(2)
    got = by_id(nd.classes(docs(texts)))
    assert {i: r["class_id"] for i, r in got.items()} == expected(texts, list(range(len(texts))))


def test_banded_alignment_equals_lcs_inside_the_band():
    r = random.Random(5)
    for _ in range(200):
        a = np.array([r.randrange(30) for _ in range(r.randrange(1, 60))], np.uint64)
        b = np.array([x for x in a if r.random() > 0.1] + [5], np.uint64)
        assert nd.banded(a, b, len(a) + len(b)) == lcs(a.tolist(), b.tolist())


def test_linked_equals_definition():
    r = random.Random(6)
    for _ in range(150):
        a = prose(r, r.randrange(5, 120))
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            k = r.randrange(len(b))
            b[k : k + r.randrange(2)] = prose(r, r.randrange(2))
        x, y = nd.word_codes(" ".join(a)), nd.word_codes(" ".join(b))
        want = bool(len(x) and len(y)) and nd.similar(lcs(x.tolist(), y.tolist()), len(x), len(y))
        assert nd.linked(x, y, nd.labelled(x), nd.labelled(y)) == want


def test_recall_on_planted_edits(docs, by_id):
    """Every twentieth word replaced, dropped or doubled: few five-word shingles are left, most words are."""
    r = random.Random(11)
    texts, alone = [], 60
    for i in range(150):
        words = prose(r, r.randrange(60, 400))
        copy = []
        for w in words:
            copy += {0: ["edit"], 1: [], 2: [w, w]}.get(r.randrange(60), [w])
        texts += [" ".join(words), " ".join(copy)]
    texts += [" ".join(prose(r, 100)) for _ in range(alone)]
    got = by_id(nd.classes(docs(texts)))
    assert sum(got[i]["class_id"] == got[i + 1]["class_id"] for i in range(0, 300, 2)) >= 0.95 * 150
    assert all(got[i]["class_id"] == i for i in range(300, 300 + alone))


def test_sketches_of_a_long_text_in_steps(monkeypatch):
    s, seeds = nd.shingles(" ".join(prose(random.Random(12), 500))), nd._seeds()
    whole = nd.sketches(s, seeds)
    monkeypatch.setattr(nd, "AT_ONCE", 700)
    assert (nd.sketches(s, seeds) == whole).all()


def test_clashing_columns(docs):
    from pyspark.sql import functions as F

    df = docs(["a b c d e f g h"] * 2 + ["x y z"]).withColumns({c: F.lit("mine") for c in ("row", "id", "__id", "digest", "label", "class_id", "a", "band")})
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    assert nd.classes(df).count() == 3


def test_order_matters_to_sketches():
    r = random.Random(7)
    w = prose(r, 400)
    swapped = w[200:] + w[:200]
    seeds = nd._seeds()
    one, two = nd.sketches(nd.shingles(" ".join(w)), seeds), nd.sketches(nd.shingles(" ".join(swapped)), seeds)
    assert (one != two).sum() >= len(seeds) // 2
    assert (one == nd.sketches(nd.shingles(" ".join(w).upper()), seeds)).sum() >= 0 and len(one) == nd.SKETCHES


def test_many_copies_stay_one_class(docs, by_id):
    r = random.Random(8)
    base = prose(r, 120)
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 120)]
    got = by_id(nd.classes(docs([" ".join(base)] * 300 + near)))
    assert {x["class_id"] for x in got.values()} == {0}


def test_deduplicate_keeps_one_row_of_each_class(docs):
    texts = ["a b c d e f g h"] * 3 + [None, None, "other text of its own here"]
    df = docs(texts, ids=[4, 4, 9, 1, 2, None])
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    assert nd.classes(docs([])).count() == 0 and nd.deduplicate(docs([])).count() == 0


def test_a_hot_pair_of_shingles_sends_texts_to_their_own_length(spark, docs, by_id, monkeypatch):
    """Texts of all lengths share a line, so one bucket holds all of them: rows sent stay far below texts times parts, and
    near copies in it are found."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(nd, "PART", 32)
    r = random.Random(13)
    line = prose(r, 150)
    texts = []
    for _ in range(300):
        own = prose(r, int(10 * 1.01 ** r.randrange(420)) + 1)
        copy = list(own)
        if len(copy) > 12:
            copy[r.randrange(len(copy))] = "edit"
        texts += [" ".join([*line, *own]), " ".join([*line, *copy])]
    sent, true_deal = [], nd.deal

    def counted(named, open_):
        out = true_deal(named, open_).cache()
        hot = open_.orderBy(F.desc("n"), "band").first()
        sent.append((out.filter((F.col("band") == hot["band"]) & (F.col("value") == hot["value"])).count(), hot["n"]))
        return out

    monkeypatch.setattr(nd, "deal", counted)
    got = by_id(nd.classes(docs(texts)))
    rows, n = sent[0]
    assert n > 8 * nd.PART and rows * 1.5 < n * -(-n // nd.PART)
    words = [nd.word_codes(t) for t in texts]
    linked = lambda i, j: nd.linked(words[i], words[j], nd.labelled(words[i]), nd.labelled(words[j]))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert [got[i]["class_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
