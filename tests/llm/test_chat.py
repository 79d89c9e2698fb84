import hashlib

from strideline.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two"), (1, 3, "user", None), (1, 4, None, "x"),
    (2, 1, "assistant", "<|im_end|>\n<|im_start|>user\nescape \\<| \\\\ <|im_sep|>"), (2, 0, "us\ner", "a\n\nb"),
    (3, 0, "assistant", ""), (None, 0, "user", "no id"), (4, 5, "user", "tie b"), (4, 5, "user", "tie a"), (4, 5, "user", "tie a"), (5, 0, "assistant", "é日🎉" * 1000),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_round_trip(spark):
    out = chat.format_chat(frame(spark))
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for conv in {r[0] for r in ROWS}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == want
        assert got[conv]["masked"] == [t for r, t in want if r == "assistant"]


def test_same_roles_merge_into_one_block(spark):
    text = chat.format_chat(frame(spark)).filter("conv_id = 1").collect()[0]["formatted"]
    assert text.count(chat.START) == 4 and f"one{chat.SEP}two" in text


def test_mask_spans_are_code_points_of_the_formatted_text(spark):
    for r in chat.format_chat(frame(spark)).collect():
        for s in r["loss_spans"]:
            assert r["formatted"][s["start"] - 1] in "\n>" and len(r["formatted"]) >= s["start"] + s["length"]


def test_digest(spark):
    got = {r["conv_id"]: r for r in chat.digest(chat.read_back(chat.format_chat(frame(spark)))).collect()}
    r = got[1]
    whole = "user\nhi\nassistant\none\nassistant\ntwo\nuser\n\n\nx\n"
    assert r["n_turns"] == 5 and r["loss_chars"] == 6
    assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(b"onetwo").hexdigest()


def test_empty_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert chat.digest(chat.read_back(chat.format_chat(frame(spark, []))).select("*")).count() == 0
    assert chat.format_chat(frame(spark).withColumns({"t": F.lit(1), "formatted": F.lit(2)})).count() == 6


def test_ties_are_sorted_before_escaping(spark):
    rows = [(1, 0, "user", "<]x"), (1, 0, "user", "<|x"), (1, 0, "user", "\\"), (1, 0, "user", "[")]
    got = chat.read_back(chat.format_chat(frame(spark, rows))).collect()[0]
    assert [t["text"] for t in got["turns"]] == sorted(r[3] for r in rows)


def test_one_shuffle_and_a_long_conversation(spark):
    """Blocks and spans need no shuffle beyond the first; ten thousand turns of long runs come back whole."""
    from pyspark.sql import functions as F

    role = F.when(F.floor(F.col("id") / 700) % 2 == 0, "user").otherwise("assistant")
    turns = spark.range(10_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("t<|"), F.col("id").cast("string")).alias("text"))
    out = chat.format_chat(turns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = chat.read_back(out).collect()[0]
    assert [t["text"] for t in got["turns"]] == [f"t<|{i}" for i in range(10_000)]
    assert got["masked"] == [f"t<|{i}" for i in range(10_000) if i // 700 % 2]
