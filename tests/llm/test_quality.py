import re

import pytest

from strideline.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered)}


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x\ny\nx\n\n \n \nx", "é ß 日本 # $ %", "w " * 500,
    "a b c d e f g h i a b c d e f g h j", "\x0ba\x0cb\rc\xa0d", " ".join(f"w{i % 11}" for i in range(200)), "line one\n" * 40, "q" * 100_000,
]


def test_counts_equal_brute_force(docs, by_id):
    got = by_id(q.quality_counts(docs(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert {k: got[i][k] for k in q.COUNTS} == counts(t), t and t[:40]


def test_clashing_columns_are_replaced_and_rows_kept(docs):
    from pyspark.sql import functions as F

    df = docs(TEXTS).withColumns({"n_words": F.lit("mine"), "__words": F.lit(1), "fence": F.lit(2)})
    assert q.quality_counts(df).count() == len(TEXTS)
    kept = q.apply_quality(df)
    assert kept.columns == df.columns
    assert all(r["n_words"] == "mine" for r in kept.collect())


def test_bins_keep_seven_bits(spark):
    from pyspark.sql import functions as F

    got = {r[0]: r[1] for r in spark.range(0, 5000).select("id", q.bin_of(F.col("id")).alias("b")).collect()}
    for x, b in got.items():
        assert b <= x and (x < 128 and b == x or x - b < x / 64)


def test_sketches_merge(spark):
    rows = [("en", s, "mark_mille", int(v), 1) for s in "ab" for v in range(50)]
    sketch = spark.createDataFrame(rows, "lang string, source string, signal string, bin long, n long")
    merged = {r["bin"]: r["n"] for r in q.merge(sketch, "lang").collect()}
    assert merged == {v: 2 for v in range(50)}
    fence = q.fences(sketch, "lang").collect()[0]
    assert fence["docs"] == 100 and fence["fence"] == 24 + q.SPREAD * (24 - 4)


def limits(signals, spark):
    """signals: rows of lang, source and the four signals, none of which fails the base rules."""
    schema = "lang string, source string, " + ", ".join(f"{s} long" for s in q.SIGNALS) + ", base_failed boolean"
    return {(r["lang"], r["source"]): r.asDict() for r in q.thresholds(q.sketches(spark.createDataFrame([(*x, False) for x in signals], schema))).collect()}


def test_every_fence_follows_its_group(spark):
    # Two sources of one language, of 4,000 documents each, whose signals differ by a factor of two.
    rows = [("en", s, *(k * (20 + i % 7) for _ in q.SIGNALS)) for s, k in (("plain", 1), ("dense", 2)) for i in range(4000)]
    got = limits(rows, spark)
    for s in q.SIGNALS:
        plain, dense = got["en", "plain"][f"max_{s}"], got["en", "dense"][f"max_{s}"]
        assert 26 < plain < dense <= 2 * 26 + 2 * q.SPREAD * 4, s


def test_a_junk_source_cannot_raise_its_own_threshold_without_limit(spark):
    rows = [("en", f"s{i % 10}", 30 + i % 9, 15 + i % 5, i % 4, 0) for i in range(4000)] + [("en", "spam", 350 + i % 90, 15, 0, 0) for i in range(2000)]
    got = limits(rows, spark)
    assert got["en", "spam"]["max_mark_mille"] < 350
    assert got["en", "s1"]["max_mark_mille"] < 350


def test_a_small_group_is_judged_by_its_language(spark):
    rows = [("en", "big", 20 + i % 7, 10, 0, 0) for i in range(5000)] + [("en", "small", 300, 10, 0, 0)] + [("de", "other", 60 + i % 7, 10, 0, 0) for i in range(5000)]
    got = limits(rows, spark)
    assert got["en", "small"]["max_mark_mille"] < 100 < 60 + q.SPREAD * 3 + got["de", "other"]["max_mark_mille"]


def test_junk_goes_and_clean_stays_also_in_a_hot_source(docs, by_id):
    clean = [" ".join(f"word{(i * 7 + j) % 97}x{j}" for j in range(40)) for i in range(240)]
    junk = [" ".join(f"w{j}###" for j in range(40)) for _ in range(30)]
    df = docs(clean + junk, sources=["hot"] * 200 + ["rare"] * 40 + ["hot"] * 15 + ["rare"] * 15, langs=["en"] * 230 + [None] * 10 + ["en"] * 30)
    got = by_id(q.score_quality(df))
    assert all(got[i]["kept"] for i in range(240))
    assert not any(got[i]["kept"] for i in range(240, 270))


@pytest.mark.parametrize("apply", [q.score_quality, q.apply_quality])
def test_empty_table(docs, apply):
    assert apply(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = q.score_quality(docs(TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
