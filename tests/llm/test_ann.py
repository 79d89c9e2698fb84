import numpy as np
from pyspark.sql import functions as F

from strideline.llm import ann


def brute(ids, x, q, k):
    s = x @ x[ids == q][0]
    s[ids == q] = -np.inf
    order = np.lexsort((ids, -s))[:k]
    return [int(i) for i in ids[order] if np.isfinite(s[list(ids).index(i)])]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [None if a is None else float(a) for a in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)


def test_recall_and_scores_on_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, (900, 1))).astype(np.float32).astype(np.float64)
    ids = np.arange(900)
    got = ann.search(frame(spark, ids, x), F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 900, 20))
    hit = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in [r["vec_id"] for r in rows]
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-9 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hit += len({r["vec_id"] for r in rows} & set(brute(ids, x, q, 20)))
    assert hit / (45 * 20) >= 0.9


def test_common_vector_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    x = [v for v in rng.normal(size=(60, 8))]
    x[10:50] = [x[10]] * 40
    extra = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 3]
    df = frame(spark, range(67), x + extra)
    df = df.unionByName(df.filter("vec_id = 20")).withColumns({"key": F.lit(1), "v": F.lit(2), "list": F.lit(3)})
    rows = [r for r in ann.search(df, F.col("vec_id") % 20 == 0, 5).collect() if r["query_id"] == 20]
    # Equal vectors aren't always nearest by inner product, but among them the smaller id comes first.
    scores = sorted(((-float(np.float32(np.array(x[20])).astype(float) @ np.float32(np.array(x[i])).astype(float)), i) for i in range(60) if i != 20))[:5]
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [i for _, i in scores]
    assert {r["vec_id"] for r in rows} <= set(range(60))


def test_few_candidates_and_none(spark):
    got = ann.search(frame(spark, [0, 1, 2], [[1, 0], [0, 1], [1, 1]]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 2, 1.0), (2, 1, 0.0)]
    assert ann.search(frame(spark, [], []), F.col("vec_id") == 0).count() == 0


def recall(spark, x, k=20):
    ids = np.arange(len(x))
    by = {}
    for r in ann.search(spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    wanted = {q: set(brute(ids, x, q, k)) for q in range(0, len(x), 20)}
    return sum(len(by[q] & w) for q, w in wanted.items()) / sum(map(len, wanted.values()))


def test_many_shards_parts_of_a_list_and_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", (16, 16))
    monkeypatch.setattr(ann, "QUERIES", 10)
    monkeypatch.setattr(ann, "TILE", 64)
    rng = np.random.default_rng(4)
    # Half of the vectors crowd in one place, so one list takes several shards.
    x = np.concatenate([rng.normal(size=(400, 12)), [3.0] * 12 + 0.01 * rng.normal(size=(400, 12))])
    assert recall(spark, x) >= 0.9


def test_grouped_vectors_need_few_probes(spark, monkeypatch):
    probes = []
    fit = ann._probes
    monkeypatch.setattr(ann, "_probes", lambda *a: probes.append((fit(*a), len(a[3]))) or probes[-1][0])
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 24)), 50, axis=0) + 0.1 * rng.normal(size=(2000, 24))
    assert recall(spark, x) >= 0.9
    assert probes[0][0] * 3 <= probes[0][1]


def test_large_and_small_finite_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6))
    x[:10] *= 1e150
    x[10:20] *= 1e-150
    assert recall(spark, x, 5) >= 0.9


def exactly(x, q, k=20):
    s = x @ x[q]
    s[q] = -np.inf
    order = np.lexsort((np.arange(len(x)), -s))[:k]
    return [(int(i), float(s[i])) for i in order]


def test_ties_of_distinct_vectors_go_to_the_smaller_id(spark, monkeypatch):
    """Small whole numbers: many distinct vectors have one exact score, and rounding of rotated ones must not order them."""
    rng = np.random.default_rng(7)
    x = np.unique(rng.integers(-1, 2, size=(1500, 16)), axis=0).astype(float)
    x = x[np.abs(x).sum(1) > 0][rng.permutation(len(x) - 1)]
    monkeypatch.setattr(ann, "TARGET", 1.0)
    monkeypatch.setattr(ann, "CHECKED", 200)
    rows = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {q: exactly(x, q) for q in range(0, len(x), 20)}


def test_recall_by_id_on_whole_numbers(spark):
    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(-1, 2, size=(1500, 16)), axis=0).astype(float)
    assert recall(spark, x[np.abs(x).sum(1) > 0]) >= 0.9


def test_exact_scores_equal_sparks_sum(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=(50, 33)), rng.normal(size=(50, 33))
    got = ann.exact(a, b, np.arange(50), np.arange(50))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i long, a array<double>, b array<double>")
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    assert [r["s"] for r in df.orderBy("i").select(score.alias("s")).collect()] == got.tolist()


def test_scan_equals_brute_force_with_a_wide_test():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(3000, 40)), rng.normal(size=(7, 40))
    full = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    limit = np.sort(full, axis=1)[:, 9] * (1 + 1e-12)
    a, b, far = ann.scan(q, x, limit, epsilon=50.0)
    for i in range(7):
        assert set(b[a == i]) == set(np.argsort(full[i])[:10]) and np.allclose(np.sort(far[a == i]), np.sort(full[i])[:10])


def test_rotation_keeps_distances():
    r = ann.rotation(9)
    assert np.allclose(r @ r.T, np.eye(9))
