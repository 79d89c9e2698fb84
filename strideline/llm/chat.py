"""Chat formatting in Spark expressions.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one block
by array aggregation, and the blocks are aggregated and concatenated:

    <|im_start|>ROLE\nTEXT<|im_end|>\n        one block
    TEXT<|im_sep|>TEXT                        inside a merged block

Texts are escaped reversibly: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no control string can
occur in them; a newline in a role becomes ``<|im_nl|>``. The loss mask is an array of spans in code points, one for
each assistant turn's escaped text. ``read_back`` recovers turns and masked texts from the formatted string alone.

How it runs. One shuffle, by conversation; what follows keeps its partitioning: the sorted turns get the number of their block
and the length before them as running sums, blocks gather their turns' texts, and conversations their blocks. So the work grows
with the turns (and their sorting), however long a conversation is.

Edge cases: null texts and roles are empty; turns with one number are ordered by role, then text; null turns come
first; a null conv_id is a conversation; repeated rows are repeated turns; an empty table gives no rows. One
conversation is one output row, so its turns must fit a task; rows are reduced to role and text before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"
#: Role whose texts are under the loss mask.
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. Gives conv_id, formatted, and loss_spans: array of (start, length), from 0, in code points."""
    df = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("raw"))
    # Escaped after sorting: escapes would change the order of ties.
    df = df.select("conv_id", F.posexplode("raw").alias("place", "t"))
    df = df.select("conv_id", "place", F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit(NEWLINE)).alias("role"), escape(F.col("t.text")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("place")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    # A turn opens a block unless the one before it has its role.
    df = df.withColumn("opens", ~F.col("role").eqNullSafe(F.lag("role").over(ordered)))
    lead = F.when(F.col("opens"), F.when(F.col("place") > 0, len(END) + 1).otherwise(0) + len(START) + F.length("role") + 1).otherwise(len(SEP))
    n = F.length("text").cast("long")
    df = df.withColumns({"block": F.count_if("opens").over(so_far), "start": F.sum(lead + n).over(so_far) - n})
    span = F.when(F.col("role") == TRAINED, F.struct("start", n.alias("length")))
    blocks = df.groupBy("conv_id", "block").agg(F.first("role").alias("role"), F.sort_array(F.array_agg(F.struct("place", "text", span.alias("span")))).alias("ts"))
    body = F.array_join(F.transform("ts", lambda t: t["text"]), SEP)
    spans = F.array_compact(F.transform("ts", lambda t: t["span"]))
    blocks = blocks.select("conv_id", F.struct("block", F.concat(F.lit(START), "role", F.lit("\n"), body, F.lit(f"{END}\n")).alias("text"), spans.alias("spans")).alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.array_agg("b")).alias("bs"))
    return whole.select("conv_id", F.array_join(F.transform("bs", lambda b: b["text"]), "").alias("formatted"), F.flatten(F.transform("bs", lambda b: b["spans"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted_chars, turns: array of (role, text), and masked: array of the texts under the mask, from formatted and loss_spans."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    df = formatted.select("conv_id", "formatted", "loss_spans", F.transform(blocks, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), b.alias("block"))).alias("bs"))
    role = lambda b: unescape(F.replace(b["role"], F.lit(NEWLINE), F.lit("\n")))
    body = lambda b: F.substring(b["block"], F.length(b["role"]) + 2, F.length(b["block"]) - F.length(b["role"]) - 2 - len(END))
    turns = F.flatten(F.transform("bs", lambda b: F.transform(F.split(body(b), r"<\|im_sep\|>"), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text")))))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return df.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), masked.alias("masked"))


def digest(back: DataFrame) -> DataFrame:
    """One row for each conversation: what read_back found, as counts and digests."""
    whole, loss = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), F.array_join("masked", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
