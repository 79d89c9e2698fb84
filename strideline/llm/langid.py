"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. Every byte has an embedding; filters of several widths run
over each window, the largest response of each filter is kept, and a softmax layer gives probabilities. A filter's
response is a sum of one number for each of its places and the byte there, so inference adds rows of tables over pairs
of bytes. Windows' log-probabilities are averaged over the text, weighted by their lengths.

Training reads the labelled rows only. Whole texts are cut into windows, of which each language gives at most about SAMPLE
different ones, those of smallest hash of their bytes (a bounded, documented sample: only these windows come to the driver).
How often a window or a document is repeated, and what its doc_id is, makes no difference, and no language that has a text with
a letter is left without windows. Labels come to the driver too, so more than LANGUAGES of them are an error, not a choice.
Everything is seeded.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled row every text is ``und``;
texts shorter than a window are padded with zero bytes; texts are predicted whole; repeated rows get one answer each;
rows of null languages aren't learned from; labels of a language are its exact strings; equal probabilities go to the first
of them; equal windows of a language are learned once; a null doc_id is in fold 0, so it is learned from; ``predict`` replaces input columns named lang_pred and
score, other names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
#: Windows of a language, and languages, at most.
SAMPLE, LANGUAGES = 2000, 512
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.01, 7
UNKNOWN = "und"
#: Windows in one matrix of responses.
AT_ONCE = 48


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of bytes, and their lengths. The last two overlap, so that none is nearly empty."""
    n = len(data)
    if n <= WINDOW:
        out = np.zeros((1, WINDOW), np.uint8)
        out[0, :n] = np.frombuffer(data, np.uint8)
        return out, np.array([n], np.float32)
    raw, k = np.frombuffer(data, np.uint8), -(-n // WINDOW)
    lengths = np.full(k, WINDOW, np.float32)
    lengths[-1] = n - WINDOW * (k - 1)
    return np.concatenate([raw[: WINDOW * (k - 1)].reshape(k - 1, WINDOW), raw[None, n - WINDOW :]]), lengths


class ByteCnn:
    """weights: embedding (256, E), one (width, E, F) array for each width with a bias, and the output layer."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.w = {"emb": rng.normal(0, 0.5, (256, EMBED))}
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k, EMBED, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self.w["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        self.w["bias"] = np.zeros(len(langs))
        self.tables: tuple[np.ndarray, ...] | None = None

    def _forward(self, x: np.ndarray):
        e = self.w["emb"][x]  # (n, window, E)
        pooled, at = [], []
        for k in WIDTHS:
            m = x.shape[1] - k + 1
            r = sum(e[:, i : i + m] @ self.w[f"f{k}"][i] for i in range(k)) + self.w[f"b{k}"]
            best = r.argmax(axis=1)
            at.append(best)
            pooled.append(np.take_along_axis(r, best[:, None, :], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        z = np.maximum(h, 0) @ self.w["out"] + self.w["bias"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return h, at, p / p.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; only the places that won the pooling have any."""
        h, at, p = self._forward(x)
        n = len(x)
        d = (p - np.eye(len(self.langs))[y]) / n
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["bias"] = np.maximum(h, 0).T @ d, d.sum(axis=0)
        dh = (d @ self.w["out"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for j, k in enumerate(WIDTHS):
            dk = dh[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"b{k}"] = dk.sum(axis=0)
            for i in range(k):
                b = x[rows, at[j] + i]  # (n, F): the byte below place i of the winner
                g[f"f{k}"][i] = np.einsum("nfe,nf->ef", self.w["emb"][b], dk)
                np.add.at(g["emb"], b.ravel(), (dk[:, :, None] * self.w[f"f{k}"][i].T[None]).reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> ByteCnn:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(SEED)
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                for k, g in self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        self.tables = None
        return self

    def _pair_tables(self) -> tuple[np.ndarray, ...]:
        """For each pair of neighbouring places a table over pairs of bytes: (65536, all filters)."""
        if self.tables is None:
            widest, all_ = max(WIDTHS), len(WIDTHS) * FILTERS
            single = np.zeros((widest + widest % 2, 256, all_), np.float32)
            for j, k in enumerate(WIDTHS):
                for i in range(k):
                    single[i, :, j * FILTERS : (j + 1) * FILTERS] = self.w["emb"] @ self.w[f"f{k}"][i]
            self.tables = tuple((single[i][:, None] + single[i + 1][None]).reshape(65536, all_) for i in range(0, len(single), 2))
        return self.tables

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, languages). A filter narrower than the widest also runs over the window's last places."""
        tables, out = self._pair_tables(), []
        bias = np.concatenate([self.w[f"b{k}"] for k in WIDTHS])
        for i in range(0, len(x), AT_ONCE):
            b = x[i : i + AT_ONCE].astype(np.uint16)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            m = x.shape[1] - 2 * len(tables) + 1
            r = tables[0][pairs[:, :m]]
            for t in range(1, len(tables)):
                r += tables[t][pairs[:, 2 * t : 2 * t + m]]
            h = r.max(axis=1).astype(np.float64) + bias
            tail = x[i : i + AT_ONCE, m:]
            e = self.w["emb"][tail]
            for j, k in enumerate(WIDTHS):
                if (left := tail.shape[1] - k + 1) > 0:
                    edge = sum(e[:, s : s + left] @ self.w[f"f{k}"][s] for s in range(k)).max(axis=1) + self.w[f"b{k}"]
                    h[:, j * FILTERS : (j + 1) * FILTERS] = np.maximum(h[:, j * FILTERS : (j + 1) * FILTERS], edge)
            z = np.maximum(h, 0) @ self.w["out"] + self.w["bias"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        held: list[np.ndarray] = []
        owners, weights, n = [], [], 0
        total = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts))

        def settle() -> None:
            nonlocal held, owners, weights, n
            if held:
                logs = self.log_probabilities(np.concatenate(held))
                w = np.concatenate(weights)
                np.add.at(total, np.concatenate(owners), logs * w[:, None])
                np.add.at(size, np.concatenate(owners), w)
            held, owners, weights, n = [], [], [], 0

        for i, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            x, w = windows(text.encode("utf-8", "replace"))
            held.append(x)
            weights.append(w)
            owners.append(np.full(len(x), i))
            n += len(x)
            if n >= 1024:
                settle()
        settle()
        for i in np.flatnonzero(size):
            mean = total[i] / size[i]
            p = np.exp(mean - mean.max())
            k = int(p.argmax())
            out[i] = (self.langs[k], float(p[k] / p.sum()))
        return out


def train(labelled: DataFrame) -> ByteCnn:
    """labelled: text, lang. Trains on the driver on the bounded sample of windows."""
    # Most texts have a letter at their beginning; only the others are turned into Java strings whole.
    letter = F.substring("text", 1, WINDOW).rlike(r"\p{L}") | F.col("text").rlike(r"\p{L}")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").filter(letter).select("lang", F.col("text").cast("binary").alias("b"))

    def of_windows(made: Callable[[Callable[[Column], Column], Column], Column]) -> Column:
        """made(window of a number, numbers of all windows). Inside an outer lambda the bytes are one array that windows are
        cut from; as a column, each mention in a lambda would copy the whole text for each window."""

        def of(b: Column) -> Column:
            size = F.octet_length(b)
            begin = lambda i: F.greatest(F.lit(0), F.least(i * WINDOW, size - WINDOW)) + 1
            last = F.greatest(F.ceil(size / WINDOW), F.lit(1)).cast("int") - 1
            return made(lambda i: F.substring(b, begin(i), F.lit(WINDOW)), F.sequence(F.lit(0), last))

        return F.transform(F.array("b"), of)[0]

    hashes = rows.select("lang", F.explode(of_windows(lambda window, all_: F.transform(all_, lambda i: F.xxhash64(window(i))))).alias("h"))
    totals = hashes.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(LANGUAGES + 1).collect()
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: {labelled.select('lang').distinct().count()}")
    langs = sorted(r["lang"] for r in totals)
    cnn = ByteCnn(langs)
    if not langs:
        return cnn
    # A window is chosen by its own hash, so no language's rows meet in a task; a few more than needed come, for chance.
    share = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(1.2 * (SAMPLE + 10 * SAMPLE**0.5) / max(1, r["n"])))])[F.col("lang")]
    few = lambda h: F.shiftrightunsigned(h, 1) < F.col("share") * F.lit(float(2**63))
    found = of_windows(lambda window, all_: F.transform(F.filter(all_, lambda i: few(F.xxhash64(window(i)))), window))
    chosen = rows.withColumn("share", share).select("lang", F.explode(found).alias("w")).distinct()
    by: dict[str, list[tuple[int, bytes]]] = {x: [] for x in langs}
    for r in chosen.select("lang", "w", F.xxhash64("w").alias("h")).collect():
        by[r["lang"]].append((r["h"], bytes(r["w"])))
    if empty := [x for x in langs if not by[x]]:
        raise ValueError(f"no windows of {empty}")
    sample = [(y, w) for y, x in enumerate(langs) for _, w in sorted(by[x], key=lambda c: (c[0] & (1 << 64) - 1, c[1]))[:SAMPLE]]
    x = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for _, w in sample), np.uint8).reshape(len(sample), WINDOW)
    return cnn.fit(x, np.array([y for y, _ in sample]))


def tell(docs: DataFrame, cnn: ByteCnn, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of keep, all columns by default), lang_pred and score; the model, a few hundred kB, goes to the tasks with
    the function, and a text that is kept goes there once."""
    keep = docs.columns if keep is None else keep
    weights, langs, at = cnn.w, cnn.langs, keep.index("text") if "text" in keep else None
    # The caller's columns travel as one struct, so none of their names can clash with those made here.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    df = docs.select(row.alias("row"), *([F.col("text").alias("text")] if at is None else []))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = ByteCnn(langs)
        model.w = weights
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                texts = part.column("text") if at is None else part.column("row").field(at)
                found = model.predict(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["row", "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([df.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(run, schema)


def predict(docs: DataFrame, cnn: ByteCnn, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default) with lang_pred and score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    return tell(docs, cnn, keep).select(*[F.col("row").getField(c).alias(c) for c in keep], "lang_pred", "score")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 3: 1 is held out; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0).cast("long"))
