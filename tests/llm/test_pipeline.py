import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from strideline.llm import entry, langid, neardup, quality, secret_scan


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    """Each stage's documents, as the driver runs them."""
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, sf_dir).write.parquet(str(base / str(i)))
        docs = spark.read.parquet(str(base / str(i)))
    return [*out, docs]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_what_their_operators_keep(run):
    start, good, known, single, masked, packed = run
    assert ids(good) == sorted(r["doc_id"] for r in quality.score_quality(start).filter("kept").collect())
    model = langid.train(good.filter(langid.fold() != 1))
    told = {r["doc_id"]: r for r in langid.predict(good, model, ["doc_id"]).collect()}
    assert ids(known) == sorted(d for d, r in told.items() if r["lang_pred"] != "und" and r["score"] >= 0.5)
    classes = neardup.classes(known).collect()
    assert ids(single) == sorted({r["class_id"] for r in classes})
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"]) and not any(k in (1, 2) for _, k, _ in secret_scan.find(r["text"]))
    assert ids(masked) == ids(single) and sorted({r["doc_id"] for r in packed.collect()}) == ids(masked)
    for a in (good, known, single, masked):
        assert a.columns == start.columns


def test_run_equals_stages(spark, sf_dir, run):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted({k[0] for k in key(whole)}) == sorted({k[0] for k in key(run[-1])})
    assert sum(k[2] for k in key(whole)) == sum(k[2] for k in key(run[-1]))


#: Extra columns whose names the operators use themselves.
CLASHING = ["row", "__row", "__text", "_", "lang_pred", "score", "start", "length", "block", "part", "fold", "n_words", "kept", "base_failed", "shard", "ids", "digest", "label", "class_id", "id", "h", "key", "secrets", "tokens", "batch"]
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *((c, pa.string()) for c in CLASHING)])
EDGES = {
    "empty": [],
    "odd": [(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "no id but some words to keep it company", "en", "s", 5), (3, "word " * 50_000, "de", "s", 1), (4, "x" * 300_000, None, "s", 1), (5, "tie", "en", "s", 3), (6, "tie", "en", "s", 3)],
}


@pytest.mark.parametrize("case", EDGES)
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.split("_")[0] not in ("op2", "op3", "op11", "op12")] + ["pipeline"])
def test_no_query_crashes_on_edges(spark, tmp_path, case, name):
    rows = [(*r, *["mine"] * len(CLASHING)) for r in EDGES[case]]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(DOCS), DOCS)], schema=DOCS), tmp_path / "documents.parquet")
    query = corpus_pipeline.run if name == "pipeline" else entry.queries()[name]
    got = query(spark, str(tmp_path)).collect()
    if case == "empty":
        assert got == []
    elif name not in ("op4_packing", "pipeline"):
        assert len(got) == len(rows)
