"""Chat formatting by prefix-target expansion, in built-in DataFrame functions only.

Template: a turn is ``<|role|>text</s>``.  In texts ``&`` and ``<`` (in roles also ``|``) are written ``&amp;``, ``&lt;``,
``&#124;``, so that no text can hold a control string and the text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "</s>"
#: in the order of writing; read back in the opposite order
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("|", "&#124;")]


def escape(text: Column, role: bool = False) -> Column:
    for raw, coded in ESCAPES if role else ESCAPES[:2]:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_col``, ``n_turns``, ``formatted`` (all turns), ``targets`` (array of
    ``at, loss_start, loss_end, stop``: a trained turn's number, its text's code points in ``formatted``, its turn's end).

    Turns are ordered by ``turn_col`` (null first), ties by role and text; equal rows are turns of their own.  Null
    text or role: empty.  Null conversation id: one conversation.  Other columns are ignored.  A conversation is one row
    of the result and thus has to fit one row.
    """
    rows = turns.select(
        F.col(conv_col).alias("_c"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    w = Window.partitionBy("_c").orderBy("_turn", "_role", "_text")
    head, body = F.concat(F.lit(OPEN), escape(F.col("_role"), role=True), F.lit(CLOSE)), escape(F.col("_text"))
    rows = rows.select(
        "_c",
        F.row_number().over(w).alias("_at"),
        (F.col("_role") == trained).alias("_trained"),
        F.length(head).cast("long").alias("_head"),
        F.concat(head, body, F.lit(END)).alias("_seg"),
        F.sum(F.length(F.concat(head, body, F.lit(END))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_stop"),
    )
    target = F.struct(
        F.col("_at").alias("at"),
        (F.col("_stop") - F.length("_seg") + F.col("_head")).alias("loss_start"),
        (F.col("_stop") - len(END)).alias("loss_end"),
        F.col("_stop").alias("stop"),
    )
    return rows.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_seg"))), lambda x: x["_seg"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("_trained"), target))).alias("targets"),
    ).withColumnRenamed("_c", conv_col)


def expand_examples(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Every trained turn as an example of its own: ``conv_col, example, text, loss_start, loss_end, last``.

    ``text`` is all turns up to and with the target; only its code points ``loss_start`` to ``loss_end`` are trainable.
    Turns after the last trained turn (or all, if none is trained) come in one more example without trainable text
    (``loss_start = loss_end``), so that the examples hold the whole conversation; ``last`` marks the longest example.
    """
    whole = F.length("formatted").cast("long")
    done = F.coalesce(F.try_element_at("targets", F.lit(-1))["stop"], F.lit(0).cast("long"))
    rest = F.array(F.struct(F.col("n_turns").cast("int").alias("at"), whole.alias("loss_start"), whole.alias("loss_end"), whole.alias("stop")))
    examples = F.when(done < whole, F.concat("targets", rest)).otherwise(F.col("targets"))
    return (
        conversations.withColumn("_examples", examples)
        .select(conv_col, "formatted", F.size("_examples").alias("_n"), F.posexplode("_examples").alias("example", "_x"))
        .select(
            conv_col,
            "example",
            F.expr("substring(formatted, 1, cast(_x.stop as int))").alias("text"),
            F.col("_x.loss_start").alias("loss_start"),
            F.col("_x.loss_end").alias("loss_end"),
            (F.col("example") == F.col("_n") - 1).alias("last"),
        )
    )


def read_turns(text: Column) -> Column:
    """The ``array<struct<role, text>>`` that an example's text was made of."""
    pieces = F.split(text, END)

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, CLOSE, 1)
        return F.struct(
            unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(role) + F.lit(len(CLOSE) + 1))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse)


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, as it was before escaping."""
    return unescape(F.substr(text, (start + 1).cast("int"), (end - start).cast("int")))
