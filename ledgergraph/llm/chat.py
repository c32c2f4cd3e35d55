"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes its own example: all preceding turns are the
context, and only that reply is trainable (``loss_start``, ``loss_chars``: code
point span in ``formatted``).  Turns after a conversation's last assistant
turn have no target; they are kept in one more record without a loss span, so
that the output holds every turn and can be read back.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn.  Control strings inside
roles and texts are escaped reversibly: a backslash becomes ``\\s``; each control
string gets ``\\p`` after its first character, so none is left in a text.

Defined cases: null role or text count as empty; turns are ordered by (turn,
role, text), so ties and repeated rows have one order and all stay; a null
conv_id is a conversation of its own; a conversation without an assistant has
the record without a loss span only; an empty table gives empty results; extra
columns are not read.  A conversation's rows meet in one row, as an example
needs its whole context; conversations are dealt by conv_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Openers of control strings that must not appear in a formatted role or text.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    for s in controls:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\p{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\p"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def render(role: Column, text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.concat(F.lit(TURN), escape(role, controls), F.lit(TEXT), escape(text, controls), F.lit(END))


def examples(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             target: str = "assistant", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_start, loss_chars): one row per target turn, and one for turns after the last.

    ``loss_start`` is 0-based and null where nothing is trainable.  The example is cut out after its row is exploded,
    so a conversation's prefixes never stand in memory together.
    """
    blank = F.lit("")
    turns = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                      F.coalesce(F.col(f"`{role}`"), blank).alias("role"),
                      F.coalesce(F.col(f"`{text}`"), blank).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    conv = conv.select(
        "conv_id", F.transform("ts", lambda t: render(t["role"], t["text"], controls)).alias("segs"),
        F.transform("ts", lambda t: F.length(escape(t["text"], controls))).alias("lens"),
        F.filter(F.sequence(F.lit(1), F.size("ts")),
                 lambda k: (F.get(F.col("ts"), k - 1)["role"] == target) | (k == F.size("ts"))).alias("ends"),
        F.transform("ts", lambda t: t["role"] == target).alias("is_target"))
    one = conv.select("conv_id", "segs", "lens", "is_target", F.explode("ends").alias("k"))
    one = one.select("conv_id", F.col("k").cast("long").alias("n_turns"),
                     F.array_join(F.slice("segs", F.lit(1), F.col("k")), "").alias("formatted"),
                     F.get("lens", F.col("k") - 1).alias("reply"), F.get("is_target", F.col("k") - 1).alias("trains"))
    start = F.length("formatted") - F.col("reply") - len(END)
    return one.select("conv_id", "n_turns", "formatted",
                      F.when(F.col("trains"), start).cast("long").alias("loss_start"),
                      F.when(F.col("trains"), F.col("reply")).cast("long").alias("loss_chars"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    body = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 2_000_000_000)
    return F.transform(body, lambda s: F.struct(
        unescape(F.substring_index(s, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, TEXT, -1), END, 1)).alias("text")))


def digests(ex: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: turn and loss digests and sizes.

    The examples of a conversation are already together (the explode keeps the partitioning), so this adds no shuffle.
    """
    learned = unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"),
                                   F.col("loss_chars").cast("int")))
    rows = ex.select("conv_id", "n_turns", "formatted", learned.alias("learned"))
    per = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max_by("formatted", "n_turns").alias("longest"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_turns", "learned"))),
                                 lambda x: F.coalesce(x["learned"], F.lit(""))), "").alias("loss_text"))
    flat = F.array_join(F.transform(read_back(F.col("longest")),
                                    lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select("conv_id", "n_turns", F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
