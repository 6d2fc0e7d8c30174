"""Conversations as marked-up text with a loss mask, by Spark expressions only.

A turn is ``<|im_start|>role``, a line end, the text and ``<|im_end|>`` with a
line end.  Adjacent turns of one role share one frame with ``<|im_sep|>``
between their texts.  Inside roles and texts a backslash is doubled and ``<|``
becomes ``<\\|`` (in roles a line end also gets a backslash), so the marks
occur nowhere else and reading back is exact.

Turns are collected, sorted and merged in pieces of 256 turn numbers; a window
over the pieces of a conversation tells whether a frame goes on across their
border and where each piece starts.  Only finished text meets in the row of a
conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planlens.llm.text_stats import let

#: Marks of the template; fixed values.
START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
TURNS = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _joined(parts: Column, between: str = "") -> Column:
    return F.array_join(parts, between)


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (start, length in code points), n_merged for rows conv_id, turn, role, text.

    Turns are sorted by turn, role and text, missing values first; a missing
    role or text is the empty one; rows without conv_id are one conversation;
    repeated rows are repeated turns; other columns are ignored; an empty table
    gives an empty one.  The mask holds the texts of role ``trained``, none of
    the marks.  A conversation is one value, so its text must fit a task.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.expr(f"cast(turn as bigint) div {TURNS}").alias("_piece"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        ).alias("_turn"),
    )
    pieces = rows.groupBy("conv_id", "_piece").agg(F.array_sort(F.collect_list("_turn")).alias("t"))
    heads = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get(F.col("t"), i)["role"] != F.get(F.col("t"), i - 1)["role"]),
    )
    merged = let(
        heads,
        lambda h: F.transform(
            h,
            lambda at, k: F.struct(
                F.get(F.col("t"), at)["role"].alias("role"),
                F.transform(
                    F.slice("t", at + 1, F.coalesce(F.get(h, k + 1), F.size("t")) - at), lambda x: x["text"]
                ).alias("texts"),
            ),
        ),
    )
    pieces = pieces.select("conv_id", "_piece", merged.alias("m"))
    along = Window.partitionBy("conv_id").orderBy(F.col("_piece").asc_nulls_first())
    first, last = F.get(F.col("m"), F.lit(0))["role"], F.element_at("m", -1)["role"]
    pieces = pieces.withColumns(
        {
            "_goes_on": F.coalesce(F.lag(last).over(along) == first, F.lit(False)),
            "_carries": F.coalesce(F.lead(first).over(along) == last, F.lit(False)),
        }
    )
    framed = F.transform(
        F.col("m"),
        lambda g, k: F.struct(
            F.when((k == 0) & F.col("_goes_on"), F.lit(SEP))
            .otherwise(F.concat(F.lit(START), F.replace(escape(g["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")))
            .alias("head"),
            (g["role"] == trained).alias("loss"),
            g["texts"].alias("texts"),
            F.when((k == F.size("m") - 1) & F.col("_carries"), F.lit("")).otherwise(F.lit(END)).alias("tail"),
        ),
    )
    pieces = pieces.withColumn("f", framed)
    # (length, in the mask) of all parts in turn; its running sum gives the spans
    runs = F.flatten(
        F.transform(
            F.col("f"),
            lambda g: F.concat(
                F.array(F.struct(F.length(g["head"]).alias("n"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        g["texts"],
                        lambda t, j: F.concat(
                            F.array(F.struct(F.when(j > 0, len(SEP)).otherwise(0).alias("n"), F.lit(False).alias("loss"))),
                            F.array(F.struct(F.length(t).alias("n"), g["loss"].alias("loss"))),
                        ),
                    )
                ),
                F.array(F.struct(F.length(g["tail"]).alias("n"), F.lit(False).alias("loss"))),
            ),
        )
    )
    empty = "cast(struct(0L as pos, array() as spans) as struct<pos:bigint,spans:array<struct<start:bigint,length:bigint>>>)"
    spans = F.aggregate(
        runs,
        F.expr(empty),
        lambda acc, r: F.struct(
            (acc["pos"] + r["n"]).alias("pos"),
            F.when(
                r["loss"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct(acc["pos"].alias("start"), r["n"].cast("long").alias("length"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    body = _joined(F.transform(F.col("f"), lambda g: F.concat(g["head"], _joined(g["texts"], SEP), g["tail"])))
    pieces = pieces.select(
        "conv_id", "_piece", body.alias("text"), spans.alias("s"), (F.size("m") - F.col("_goes_on").cast("int")).alias("n")
    )
    begins = F.coalesce(F.sum("s.pos").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("_begins", begins)
    moved = F.transform(
        F.col("s.spans"), lambda x: F.struct((x["start"] + F.col("_begins")).alias("start"), x["length"].alias("length"))
    )
    whole = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_begins", "_piece", "text", moved.alias("spans")))).alias("p"),
        F.sum("n").alias("n_merged"),
    )
    return whole.select(
        "conv_id",
        _joined(F.transform("p", lambda x: x["text"])).alias("formatted"),
        F.flatten(F.transform("p", lambda x: x["spans"])).alias("loss_spans"),
        "n_merged",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, merged ones apart again."""
    frames = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.size(F.split(formatted, r"<\|im_start\|>")))

    def parse(frame: Column) -> Column:
        role = F.regexp_extract(frame, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
        body = F.substr(frame, F.length(role) + 2, F.length(frame) - F.length(role) - 1 - len(END))
        return F.transform(
            F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(frames, parse))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
