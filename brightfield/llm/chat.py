"""Chat formatting with DataFrame expressions only: turns to one training text and its loss mask, and back.

Template: ``<turn>role\\ntext</turn>\\n`` for each block of adjacent turns of one role; the texts of a block are
joined by ``<join/>``. A control string inside a text gets one more backslash after its ``<`` (``<turn>`` becomes
``<\\turn>``, ``<\\turn>`` becomes ``<\\\\turn>``), so control strings never occur in an escaped text and reading back
takes that backslash away again. In a role, a backslash is written ``\\b`` and a line feed ``\\n`` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(\\*)(/?turn>|join/>)"
OPEN, JOIN, CLOSE = "<turn>", "<join/>", "</turn>\n"
CHUNK = 256  # pieces of a conversation whose places are summed up at a time


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "<" + CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\" + CONTROL, "<$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # after a backslash stands b or n only, so neither step makes anything that the next one reads
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (array of ``start, length`` in code points, from 0).

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one defined order and none is
    dropped. Null text is an empty text, null role an empty role; a null conv_id is a conversation of its own. Texts of any
    length are kept whole; a conversation's turns are one row of the result, so they must fit one. An empty table gives no
    rows. Columns other than ``conv_id, turn, role, text`` are ignored, whatever their names.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # blocks: the places where the role changes; each block is the slice up to the next such place
    begins = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    conv = conv.withColumn("begins", begins)
    block = lambda i, j: F.struct(
        F.get("ts", i)["role"].alias("role"),
        F.transform(F.slice("ts", i + 1, F.coalesce(F.get("begins", j + 1), F.size("ts")) - i), lambda t: escape(t["text"])).alias("texts"),
    )
    conv = conv.select("conv_id", F.transform("begins", block).alias("blocks"))
    # pieces of the output in order, with whether the loss counts them
    piece = lambda text, loss: F.struct(text.alias("s"), loss.alias("loss"))
    none = F.lit(False)
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(piece(F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit("\n")), none)),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, k: F.array(piece(F.when(k > 0, F.lit(JOIN)).otherwise(F.lit("")), none), piece(x, b["role"] == loss_role)),
                    )
                ),
                F.array(piece(F.lit(CLOSE), none)),
            ),
        )
    )
    conv = conv.select("conv_id", pieces.alias("pieces"))
    conv = conv.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["s"]).cast("long").alias("n"), p["loss"].alias("loss"))).alias("sizes"),
    )
    # places of the loss pieces: sums over chunks of pieces first, so that long conversations cost no copy of all spans a turn
    long = lambda n: F.lit(n).cast("long")
    spans = F.array().cast("array<struct<start:long,length:long>>")
    zero = F.struct(long(0).alias("at"), spans.alias("spans"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["n"]).alias("at"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), p["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    chunks = F.transform(F.sequence(F.lit(1), F.size("sizes"), F.lit(CHUNK)), lambda i: F.aggregate(F.slice("sizes", i, CHUNK), zero, step))
    conv = conv.select("conv_id", "formatted", chunks.alias("chunks"))
    none = F.struct(long(0).alias("at"), F.array().cast("array<long>").alias("begins"))
    begin = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))
    conv = conv.withColumn("begins", F.aggregate("chunks", none, begin, lambda a: a["begins"]))
    moved = F.zip_with("chunks", "begins", lambda c, b: F.transform(c["spans"], lambda s: F.struct((s["start"] + b).alias("start"), s["length"].alias("length"))))
    return conv.select("conv_id", "formatted", F.flatten(moved).alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """The inverse: ``conv_id, turns`` (array of ``role, text`` in order) and ``loss_text`` read through the mask."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")
    cut_role = lambda b: F.substring_index(b, "\n", 1)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.length(cut_role(b)) + 2, F.length(b)), JOIN),
                lambda x: F.struct(unescape_role(F.substring(cut_role(b), len(OPEN) + 1, F.length(b))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns of what :func:`read_chat` reads back."""
    back = read_chat(formatted)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
