"""Chat formatting: typed content parts become marked text with a loss mask, and back.

Everything here is column expressions, windows and grouped aggregates.

A turn is ``<|im_start|>role\\n`` + content + ``<|im_end|>\\n``.  A visitor per kind of part
flattens the content in order: text is escaped (``\\`` to ``\\\\``, ``|`` to ``\\|``), an
attachment becomes the placeholder of its kind, such as ``<|image|>``, and is recorded with its
reference, its place and the number of tokens the placeholder stands for.  An escaped text holds
no bare ``|``, also where several texts meet, so no text can write a control string; roles are
URL-encoded.  Both are undone by :func:`read_turns`.

Texts are assembled in blocks of :data:`BLOCK_TURNS` turn numbers, so that a conversation with a
third of all rows is spread over as many tasks as it has blocks.  All places count code points.

Defined results: null text and null parts are empty; a null role is empty; a part of an unknown
kind is an ``other`` attachment of no tokens; a null part is skipped; rows with a null id are one
conversation; null turns come first; rows that share a turn stay apart, in the order of role and
formatted content; an empty table has no conversations.  Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK_TURNS = 32

PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,"
        "pages:int>")
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256  # pixels, tokens a second, tokens a page


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


# ---- the visitor ------------------------------------------------------------------------


def _patches(side: Column) -> Column:
    return F.ceil(F.coalesce(side, F.lit(0)) / PATCH)


#: Tokens a placeholder stands for, per kind of attachment.
ATTACHMENTS: Mapping[str, Callable[[Column], Column]] = {
    "image": lambda part: _patches(part["width"]) * _patches(part["height"]),
    "audio": lambda part: F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE),
    "document": lambda part: F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS,
}
PLACEHOLDERS = "|".join([*ATTACHMENTS, "other"])


def visit(part: Column, attachments: Mapping[str, Callable[[Column], Column]]) -> Column:
    """What one part becomes: ``(out, kind, ref, tokens)``; the kind of a text is null."""
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    kind = F.when(part["kind"].isin(*attachments), part["kind"]).otherwise(F.lit("other"))
    tokens = F.lit(0).cast("bigint")
    for name, count in attachments.items():
        tokens = F.when(part["kind"] == name, count(part).cast("bigint")).otherwise(tokens)
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit(""))))
        .otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("out"),
        F.when(~is_text, kind).alias("kind"),
        F.when(~is_text, part["ref"]).alias("ref"),
        F.when(is_text, F.lit(0).cast("bigint")).otherwise(tokens).alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as the parts of a turn."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"),
                            *[none.cast(t).alias(n) for n, t in (
                                ("ref", "string"), ("width", "int"), ("height", "int"),
                                ("seconds", "double"), ("pages", "int"))]))


# ---- formatting -------------------------------------------------------------------------


def format_turns(rows: DataFrame, parts: Column, learned: Column, id: str = "conv_id",
                 turn: str = "turn", role: str = "role",
                 attachments: Mapping[str, Callable[[Column], Column]] = ATTACHMENTS) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, segment, loss, attachments``.

    ``parts`` is an array of :data:`PART`; ``learned`` tells whether the content is under the
    loss mask.  ``loss`` is ``(start, length)`` in the segment or null; ``attachments`` holds
    ``(start, kind, ref, tokens)`` in order.  Nothing is shuffled.
    """
    given = rows.select(F.col(id).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"),
                        F.coalesce(learned, F.lit(False)).alias("learned"))
    seen = given.withColumn("seen", F.transform(
        F.filter("parts", lambda p: p.isNotNull()), lambda p: visit(p, attachments)))
    seen = seen.withColumn("head", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")))
    seen = seen.withColumn("body", F.array_join(F.transform("seen", lambda v: v["out"]), ""))
    lengths = F.transform("seen", lambda v: F.length(v["out"]))
    before = lambda i: F.aggregate(
        F.slice(lengths, 1, i), F.lit(0), lambda total, n: total + n)
    places = F.transform("seen", lambda v, i: F.struct(
        (F.length("head") + before(i)).cast("bigint").alias("start"), v["kind"].alias("kind"),
        v["ref"].alias("ref"), v["tokens"].alias("tokens")))
    attached = F.exists("seen", lambda v: v["kind"].isNotNull())
    return seen.select(
        "conv_id", "turn", "role", F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
        F.when(F.col("learned"), F.struct(
            F.length("head").cast("bigint").alias("start"),
            F.length("body").cast("bigint").alias("length"))).alias("loss"),
        F.when(attached, F.filter(places, lambda p: p["kind"].isNotNull()))
        .otherwise(F.array().cast(
            "array<struct<start:bigint,kind:string,ref:string,tokens:bigint>>"))
        .alias("attachments"))


def _moved(place: Column, by: Column) -> Column:
    return place.withField("start", place["start"] + by)


def assemble_blocks(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation and ``block_turns`` turn numbers.

    ``conv_id, block, n_turns, text, n_chars``, the ``loss`` spans and the ``attachments`` by
    place in the block.  Blocks in order make up the conversation.
    """
    rows = turns.withColumn("block", F.floor(F.col("turn") / block_turns))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "segment")
    upto = F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(upto, F.lit(0)).cast("bigint"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(
        F.struct("at", "segment", "loss", "attachments"))).alias("held"))
    loss = F.transform(F.filter("held", lambda t: t["loss"].isNotNull()),
                       lambda t: _moved(t["loss"], t["at"]))
    found = F.flatten(F.transform("held", lambda t: F.transform(
        t["attachments"], lambda a: _moved(a, t["at"]))))
    text = F.array_join(F.transform("held", lambda t: t["segment"]), "")
    return (blocks.withColumn("text", text)
            .select("conv_id", "block", F.size("held").cast("bigint").alias("n_turns"), "text",
                    F.length("text").cast("bigint").alias("n_chars"), loss.alias("loss"),
                    found.alias("attachments")))


def assemble(blocks: DataFrame) -> DataFrame:
    """Whole conversations: ``conv_id, n_turns, text, n_chars, loss, attachments, n_expanded``.

    Attachments are numbered in order by ``index``; ``n_expanded`` are the tokens all
    placeholders stand for.  A conversation is one value here and must fit one.
    """
    order = Window.partitionBy("conv_id").orderBy("block")
    upto = F.sum("n_chars").over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = (blocks.withColumn("at", F.coalesce(upto, F.lit(0)).cast("bigint"))
             .groupBy("conv_id").agg(
                 F.sum("n_turns").alias("n_turns"), F.sum("n_chars").alias("n_chars"),
                 F.array_sort(F.collect_list(F.struct("at", "text", "loss", "attachments")))
                 .alias("held")))
    moved = lambda name: F.flatten(F.transform("held", lambda b: F.transform(
        b[name], lambda p: _moved(p, b["at"]))))
    out = whole.withColumn("found", moved("attachments"))
    return out.select(
        "conv_id", "n_turns", F.array_join(F.transform("held", lambda b: b["text"]), "").alias("text"),
        "n_chars", moved("loss").alias("loss"),
        F.transform("found", lambda a, i: F.struct(i.alias("index"), *[
            a[n].alias(n) for n in ("start", "kind", "ref", "tokens")])).alias("attachments"),
        F.aggregate("found", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("n_expanded"))


# ---- reading back -----------------------------------------------------------------------


def read_turns(text: Column) -> Column:
    """``(role, content)`` of every turn of a formatted text; the content is still escaped."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    line = lambda piece: F.instr(piece, "\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: F.struct(
        F.url_decode(F.substr(piece, F.lit(len(OPEN) + 1), line(piece) - len(OPEN) - 1)).alias("role"),
        F.substr(piece, line(piece) + 1).alias("content")))


def read_parts(content: Column) -> Column:
    """``(kind, text)`` of the parts of an escaped content; attachments have no text."""
    mark = rf"<\|(?:{PLACEHOLDERS})\|>"
    pieces = F.filter(F.split(content, f"(?={mark})|(?<={mark})"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        F.when(p.rlike(f"^{mark}$"), F.regexp_extract(p, r"^<\|(\w+)\|>$", 1))
        .otherwise(F.lit("text")).alias("kind"),
        F.when(~p.rlike(f"^{mark}$"), unescape(p)).alias("text")))


def read_loss(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask of a block or conversation."""
    return F.transform(loss, lambda s: unescape(
        F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation what its blocks read back as.

    ``conv_id, n_turns, turns_sha256`` (role, newline, text, newline of every turn),
    ``loss_chars, loss_sha256`` (all text under the mask) and ``formatted_chars``.  Blocks are
    read back first; a conversation meets as one row per block.
    """
    said = F.transform(read_turns(F.col("text")), lambda t: F.concat(
        t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n")))
    read = blocks.select("conv_id", "block", "n_chars", F.size(said).cast("bigint").alias("n"),
                         F.array_join(said, "").alias("turns"),
                         F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
        F.sum(F.length("loss")).cast("bigint").alias("loss_chars"),
        F.array_sort(F.collect_list(F.struct("block", "turns", "loss"))).alias("held"))
    joined = lambda name: F.array_join(F.transform("held", lambda b: b[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"),
                        "loss_chars", F.sha2(joined("loss"), 256).alias("loss_sha256"),
                        "formatted_chars")
