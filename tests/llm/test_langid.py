import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import langid

WORDS = {"xx": ["the", "and", "ing", "with"], "yy": ["der", "und", "schön", "ung"], "zz": ["que", "été", "pour", "ment"]}


def text(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) + r.choice(WORDS[lang]) for _ in range(n))


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    cnn = langid.ByteCnn(["a", "b", "c"])
    x, y = rng.integers(0, 256, (4, 40)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(cnn._forward(x)[2][np.arange(4), y]).mean()
    g = cnn.gradients(x, y)
    for name, w in cnn.w.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(5)] + ([(int(x[0, 0]), 0)] if name == "emb" else []):
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_tables_equal_the_network():
    rng = np.random.default_rng(1)
    cnn = langid.ByteCnn(["a", "b"])
    x = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    assert np.abs(np.exp(cnn.log_probabilities(x)) - cnn._forward(x)[2]).max() < 1e-5


def test_windows_cover_every_byte_once():
    for n in (0, 1, 255, 256, 257, 1000):
        data = bytes(i % 251 for i in range(n))
        w, lengths = langid.windows(data)
        assert lengths.sum() == n and w.shape == (max(1, -(-n // 256)), 256)


def test_held_out_accuracy_and_edges(docs, by_id):
    r = random.Random(2)
    langs = [r.choice(list(WORDS)) for _ in range(300)]
    texts = [text(x, r.randrange(5, 200), r) for x in langs] + [None, "", "123 !!", "été été " * 400]
    df = docs(texts, langs=[*langs, "xx", None, "yy", None])
    model = langid.train(df.filter(langid.fold() != 1))
    got = by_id(langid.predict(df, model, ["doc_id"]).withColumn("out", langid.fold() == 1))
    held = [i for i in range(300) if got[i]["out"]]
    assert len(held) > 50 and np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 303)] == ["und", "und", "und", "zz"]
    again = by_id(langid.predict(df, langid.train(df.filter(langid.fold() != 1)), ["doc_id"]))
    assert all(again[i]["score"] == got[i]["score"] for i in got)


def test_no_labels(docs):
    df = docs(["some text", None])
    model = langid.train(df.filter("false"))
    assert {x["lang_pred"] for x in langid.predict(df, model).collect()} == {"und"}
    assert langid.predict(docs([]), model).count() == 0


def test_sample_is_bounded_and_of_whole_texts(docs, monkeypatch):
    """One document repeated many times and one far longer than the sample: windows come from all of its length."""
    monkeypatch.setattr(langid, "SAMPLE", 60)
    seen = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y, epochs=1: seen.append((x, y)) or self)
    long = " ".join(f"word{i}" for i in range(20_000))
    df = docs([long] + ["kurzer text"] * 500 + ["et un"], langs=["en"] + ["de"] * 500 + ["fr"], ids=[1] + [2] * 500 + [3])
    assert langid.train(df).langs == ["de", "en", "fr"]
    x, y = seen[0]
    assert list(np.bincount(y)) == [1, 60, 1]
    places = [long.encode().find(bytes(w)) for w in x[y == 1]]
    assert min(places) >= 0 and max(places) > len(long) * 0.8 and min(places) < len(long) * 0.2


def test_accuracy_on_given_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang IS NOT NULL")
    held = langid.predict(df.filter(langid.fold() == 1), langid.train(df.filter(langid.fold() != 1)), ["lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9


def counted(monkeypatch):
    seen = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y, epochs=1: seen.append(dict(zip(self.langs, np.bincount(y, minlength=len(self.langs)).tolist()))) or self)
    return seen


def test_repeated_rows_and_ids_cost_no_language_its_windows(spark, docs, monkeypatch):
    """A document repeated 50,000 times, one doc_id for all texts of a language, and null ids, beside an ordinary language."""
    seen = counted(monkeypatch)
    word = F.sha2(F.concat(F.lit("salt"), F.col("id").cast("string")), 256)
    own = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("plain").alias("lang"), word.alias("text"))
    again = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("again").alias("lang"), F.lit("said often").alias("text"))
    few = spark.range(1000).select((F.col("id") + 9000).alias("doc_id"), F.lit("again").alias("lang"), F.concat(F.lit("x"), word).alias("text"))
    one = spark.range(6000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one").alias("lang"), F.concat(F.lit("y"), word).alias("text"))
    none = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("none").alias("lang"), F.concat(F.lit("z"), word).alias("text"))
    langid.train(own.union(again).union(few).union(one).union(none))
    assert seen == [{"again": 1001, "none": 2000, "one": 2000, "plain": 2000}]


def test_null_ids_are_learned_from_and_too_many_languages_are_an_error(docs, monkeypatch):
    df = docs(["some text", "other text"], ids=[None, None])
    assert [r["f"] for r in df.select(langid.fold().alias("f")).collect()] == [0, 0]
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="4"):
        langid.train(docs(["a", "b", "c", "d", "a"], langs=["1", "2", "3", "4", "1"]))


def test_windows_of_a_long_text_take_no_more_than_its_size():
    data = b"some words " * 400_000
    tracemalloc.start()
    w, lengths = langid.windows(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths.sum() == len(data) and peak < 1.5 * len(data)


def test_training_copies_no_whole_text_for_each_window(docs, monkeypatch):
    """One text of 12 MB, after a beginning without a letter: copies of it for each of its 47,000 windows take minutes."""
    seen = counted(monkeypatch)
    long = "1" * 300 + " ".join(f"word{i}" for i in range(1_150_000))
    df = docs([long, "123", "kurzer text"], langs=["en", "en", "de"])
    began = time.time()
    langid.train(df)
    assert time.time() - began < 30 and seen == [{"de": 1, "en": 2000}]


def test_a_kept_text_goes_to_the_tasks_once(docs, monkeypatch):
    sent, df = [], docs(["the and", None, "der und"], ids=[1, 2, 3])
    kind = type(df)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow: sent.append(self.columns) or f(self, *a))
    model = langid.ByteCnn(["a", "b"])
    apart = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, ["doc_id"]).collect()}
    within = langid.predict(df.withColumn("_", F.lit(5)), model)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in within.collect()} == apart and apart[2] == ("und", 0.0)
    assert within.columns == [*df.columns, "_", "lang_pred", "score"] and {r["_"] for r in within.collect()} == {5}
    assert sent == [["row", "text"], ["row"]]
    assert langid.predict(df, model, []).count() == 3
