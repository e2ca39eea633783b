"""Chat formatting with Spark expressions only.

Template, per block of adjacent turns of one role::

    ### role: text<and/>text</turn>\n

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged into a block, and blocks are concatenated.  Control
strings inside texts and roles are escaped reversibly, so the formatted text
can be read back turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow

# fixed values of the template
HEAD, COLON, JOIN, END = "### ", ": ", "<and/>", "</turn>\n"
#: (control string, code); the backslash first when escaping, last when reading.
CODES = [("\\", "\\b"), ("</turn>", "\\t"), ("<and/>", "\\a"), ("### ", "\\h")]
ROLE_CODES = [*CODES, (":", "\\c")]


def _escape(c: Column, codes=CODES) -> Column:
    for raw, code in codes:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _unescape(c: Column, codes=CODES) -> Column:
    for raw, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def format_chats(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` lists (start, length) in code points of ``formatted`` for
    every text of ``loss_role``, so a mask never covers markup.

    * null text or role: empty; null conv_id: one conversation of its own
    * equal turn numbers: ordered by role, then text; repeated rows stay
    * empty table: no rows; further columns are not carried
    """
    rows = narrow(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", F.struct(
        "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # first positions of the blocks: where the role differs from the turn before
    starts = sorted_turns.withColumn("starts", F.expr(
        "filter(sequence(0, size(ts) - 1), i -> i = 0 or ts[i].role != ts[i - 1].role)"))
    blocks = starts.select("conv_id", F.expr(
        "transform(starts, (s, k) -> struct(ts[s].role as role, "
        "transform(slice(ts, s + 1, coalesce(get(starts, k + 1), size(ts)) - s), t -> t.text) as parts))"
    ).alias("blocks"))
    # pieces in order: block head, text, separator, ..., block end
    def pieces(b: Column) -> Column:
        head = F.struct(F.concat(F.lit(HEAD), _escape(b.role, ROLE_CODES), F.lit(COLON)).alias("s"),
                        F.lit(False).alias("loss"))
        body = F.transform(b.parts, lambda p, i: F.array(
            F.struct(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
            F.struct(_escape(p).alias("s"), (b.role == loss_role).alias("loss"))))
        end = F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(body), F.array(end))

    flat = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    # running offsets: lengths are summed in one pass over the pieces, spans
    # are kept as text "start:length" so the accumulator stays a flat string
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans")),
        lambda a, p: F.struct(
            (a.at + F.length(p.s)).alias("at"),
            F.when(p.loss, F.concat(a.spans, a.at.cast("string"), F.lit(":"),
                                    F.length(p.s).cast("string"), F.lit(" "))).otherwise(a.spans).alias("spans")),
        lambda a: a.spans)
    return flat.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p.s), "").alias("formatted"),
        F.transform(F.filter(F.split(spans, " "), lambda s: s != ""), lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(1)).cast("long").alias("start"),
            F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("length"))).alias("loss_spans"))


def read_chats(formatted: DataFrame, *, id_col: str = "conv_id", formatted_col: str = "formatted",
               spans_col: str = "loss_spans") -> DataFrame:
    """Back from the formatted text: conv_id, turns (role, text in order),
    loss_text (the unescaped text under the spans, nothing between)."""
    src = narrow(formatted, conv_id=id_col, formatted=formatted_col, loss_spans=spans_col)
    raw = F.filter(F.split("formatted", END), lambda b: b != "")

    def turns(b: Column) -> Column:
        colon = F.instr(b, COLON)
        role = _unescape(F.substring(b, F.lit(len(HEAD) + 1), colon - F.lit(len(HEAD) + 1)), ROLE_CODES)
        body = F.substring(b, colon + F.lit(len(COLON)), F.length(b))
        return F.transform(F.split(body, JOIN), lambda p: F.struct(
            role.alias("role"), _unescape(p).alias("text")))

    return src.select(
        "conv_id", "formatted",
        F.flatten(F.transform(raw, turns)).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: _unescape(F.substring(
            F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "").alias("loss_text"))


def digest_chats(read: DataFrame) -> DataFrame:
    """The contract's digest of ``read_chats`` output, plus the block count."""
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
