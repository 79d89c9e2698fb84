"""Quality rules with adaptive thresholds.

Every text gets counts (words, symbols, duplicate lines, repeated eight-word windows). Documents that fail the base
rules are out. The others get signals in thousandths: characters that are no letter, number or space; upper-case
letters; words equal to the one before; lines equal to an earlier one. A mergeable quantile sketch for each (language,
source) holds each signal: a log-linear histogram, whose bins are exact below 128 and keep seven significant bits above
(relative error under 1 %). Two sketches merge by adding the counts of equal bins, so the sketches of a language and of
all documents are sums of the groups'. A sketch's own fence lies as far above its median as its lower side is wide:

    median + SPREAD * max(median - 10th percentile, 1)

The signal that most documents lack (SPARSE) is judged among documents that have it. A group's threshold is its own
fence blended with its language's, and that with the fence of all, by numbers of documents (the wider one counts as
PRIOR documents), and at most BOUND times the fence of all documents. So a group follows its own distribution, a small
one its language's, and a source that is mostly junk can't raise its threshold without limit; the method needs that
less than half of all documents are junk, and a junk source with less than BOUND times the usual rate passes.
Thresholds are joined back to the documents.

Edge cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; a
group without a document that passes the base rules has no threshold and needs none; repeated rows are judged one by
one; columns of the input that clash with names made here are replaced in ``quality_counts`` and untouched by
``apply_quality``; an empty table gives an empty result. Windows and neighbouring words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, cut, new_path

#: Words in a window whose repetition counts.
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Width of a fence, documents as which the next wider sketch counts, and times that a threshold may pass the fence of all.
SPREAD, PRIOR, BOUND = 8, 100, 3
SIGNALS = ["mark_mille", "upper_mille", "echo_mille", "dup_line_mille"]
#: Signals judged among the documents that have any.
SPARSE = ["dup_line_mille"]
#: At most so many rows of thresholds are broadcast.
MAX_BROADCAST = 200_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def _shifted_pairs(hashes: Column, step: int, size: Column) -> Column:
    """Hash of element i with element i + step, for all i that have one."""
    rest = size - F.lit(step)
    return F.zip_with(F.slice(hashes, 1, rest), F.slice(hashes, F.lit(step + 1), rest), lambda a, b: F.xxhash64(a, b))


def _covered(starts: Column) -> Column:
    """Words in the union of windows that begin at the sorted starts."""
    following = F.concat(F.slice(starts, 2, F.size(starts) - 1), F.array(F.lit(2**30)))
    gaps = F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def quality_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all by default) with COUNTS and the other figures the signals need, one row for each row."""
    keep = docs.columns if keep is None else keep
    made = [*COUNTS, "n_marks", "n_upper", "n_echoes", "n_lines", *SIGNALS, "base_failed"]
    keep = [c for c in keep if c not in made]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    # The caller's columns travel as one struct, so none of their names can clash with those made here.
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), word_array(t).alias("__words"), lines.alias("__lines"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{M}}\p{{N}}{SPACES}]+", "")).cast("long").alias("n_marks"),
    )
    base = ["__row"]
    df = df.select(
        *base, "n_symbols", "n_marks", "n_upper", F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__words") >= WINDOW, F.transform("__words", lambda w: F.xxhash64(w))).alias("__h1"),
    )
    size = F.col("n_words").cast("int")
    echoes = F.zip_with(F.slice("__h1", 1, size - 1), F.slice("__h1", 2, size - 1), lambda a, b: a == b)
    df = df.withColumn("n_echoes", F.coalesce(F.size(F.filter(echoes, lambda x: x)), F.lit(0)).cast("long"))
    rest = ["n_symbols", "n_marks", "n_upper", "n_echoes", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    df = df.withColumn("__h2", _shifted_pairs(F.col("__h1"), 1, size)).drop("__h1")
    df = df.withColumn("__h4", _shifted_pairs(F.col("__h2"), 2, size - 1)).drop("__h2")
    df = df.withColumn("__h8", _shifted_pairs(F.col("__h4"), 4, size - 3)).drop("__h4")
    # Most texts repeat nothing: only for the others are the windows sorted.
    repeats = F.size(F.array_distinct("__h8")) < F.size("__h8")
    df = df.select(*base, *rest, F.when(repeats, F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__s"))
    n = F.size("__s")
    same = F.zip_with(F.slice("__s", 1, n - 1), F.slice("__s", 2, n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.select(*base, *rest, F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))).alias("__starts"))
    df = df.select(*base, *rest, F.coalesce(_covered(F.col("__starts")), F.lit(0).cast("long")).alias("n_repeat_words"))
    mille = lambda a, b: F.coalesce(F.floor(F.try_divide(F.lit(1000) * F.col(a), F.col(b))), F.lit(0)).cast("long")
    df = df.withColumns({
        "mark_mille": mille("n_marks", "word_chars"), "upper_mille": mille("n_upper", "word_chars"),
        "echo_mille": mille("n_echoes", "n_words"), "dup_line_mille": mille("n_dup_lines", "n_lines"), "base_failed": base_failed(),
    })
    return df.select(*[F.col("__row").getField(c).alias(c) for c in keep], *[c for c in df.columns if c != "__row"])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def bin_of(x: Column) -> Column:
    """The smallest value in x's bin: x itself below 128, else x with all but its seven highest bits cleared."""
    shift = F.greatest(F.length(F.bin(x)) - F.lit(7), F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return x - x % unit


def sketches(signals: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The mergeable sketches of documents that pass the base rules: lang, source, signal, bin, n. Its rows are bounded by groups x signals x bins."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bin_of(F.col(s)).alias("bin")) for s in SIGNALS]))
    found = signals.filter(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("p"))
    # Partial sums come before the shuffle: a hot source sends one row for each bin and task.
    return found.filter(~F.col("p.signal").isin(SPARSE) | (F.col("p.bin") > 0)).groupBy("lang", "source", "p.signal", "p.bin").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *by: str) -> DataFrame:
    """The sum of sketches over groups that agree in by."""
    return sketch.groupBy(*by, "signal", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *by: str) -> DataFrame:
    """by, signal, docs and fence, from cumulative counts over the bins."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "signal")
    df = sketch.withColumns({"up_to": F.sum("n").over(w.orderBy("bin")), "docs": F.sum("n").over(w)})
    at = lambda tenths: F.min(F.when(F.lit(10) * F.col("up_to") >= F.lit(tenths) * F.col("docs"), F.col("bin")))
    df = df.groupBy(*by, "signal", "docs").agg(at(1).alias("low"), at(5).alias("mid"))
    return df.select(*by, "signal", "docs", (F.col("mid") + F.lit(SPREAD) * F.greatest(F.col("mid") - F.col("low"), F.lit(1))).alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each lang and source with max_ and the signal's name: own, language's and general fence blended and bounded."""
    own, by_lang, all_ = fences(sketch, "lang", "source"), fences(merge(sketch, "lang"), "lang"), fences(merge(sketch))
    df = own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.signal") == F.col("l.signal")))
    df = df.join(F.broadcast(all_).alias("a"), F.col("o.signal") == F.col("a.signal"))  # a row a signal
    df = df.select("o.lang", "o.source", "o.signal", "o.docs", "o.fence", F.expr(f"(l.docs * l.fence + {PRIOR} * a.fence) div (l.docs + {PRIOR})").alias("wider"), F.col("a.fence").alias("general"))
    fence = F.least(F.expr(f"(docs * fence + {PRIOR} * wider) div (docs + {PRIOR})"), F.lit(BOUND) * F.col("general"))
    df = df.select("lang", "source", "signal", fence.alias("fence"))
    return df.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(f"max_{s}") for s in SIGNALS])


def _joined(signals: DataFrame, limits: DataFrame) -> DataFrame:
    """signals with kept. The thresholds are broadcast if they are few; else Spark joins by key and splits skewed keys."""
    t = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"max_{s}" for s in SIGNALS])
    if limits.count() <= MAX_BROADCAST:
        t = F.broadcast(t)
    df = signals.join(t, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    beyond = F.lit(False)
    for s in SIGNALS:
        beyond = beyond | F.coalesce(F.col(s) > F.col(f"max_{s}"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("__lang", "__source", *[f"max_{s}" for s in SIGNALS])


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, the signals, base_failed and kept for each row of docs."""
    signals = cut(quality_counts(docs, keep=["doc_id", "lang", "source"]))
    return _joined(signals, cut(thresholds(sketches(signals))))


def apply_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, unchanged. Rows and signals are written once to the shared folder, so that texts are counted once and never shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    df = docs.select(whole, F.col("text").alias("text"), F.col("lang").alias("lang"), F.col("source").alias("source"))
    path = new_path(docs.sparkSession, "quality")
    quality_counts(df, keep=["__row", "lang", "source"]).select("__row", "lang", "source", *SIGNALS, "base_failed").write.parquet(path)
    counted = docs.sparkSession.read.parquet(path)
    return _joined(counted, cut(thresholds(sketches(counted)))).filter("kept").select("__row.*")
