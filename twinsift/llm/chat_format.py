"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document.  One pass over the
list (the visitor) writes each text part, escaped, and for each other part a placeholder
that names its kind and its place, records its reference and counts the tokens it will
expand to.  A turn is written as

    <|turn|>role<|text|>content<|end|>

Each `<`, `[` and backslash of a role or text part is written as a backslash and a letter (l, b
and e), so no control string (`<|...|>`, `<s>`, `</s>`, `[INST]`, `[/INST]`) can stand in what a
speaker wrote, nor come about where two parts meet; every raw `<` in the output belongs to the
template, so placeholders can't be forged either.  Turning the letters back gives the text.

Defined cases: a null role or text is empty; a null or empty list of parts is an empty
content; a kind that isn't known counts as document; sizes that are null count as one token's
worth, those below zero or not a number as none, and one attachment as 2**40 tokens at most;
turns that share a number go by role, then content; repeated rows are turns of their own; other
columns, whatever their names, are ignored; a null conv_id is a conversation; an empty table
gives an empty result.  A conversation is one output row, so its text must fit in one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The markers and what is escaped (the backslash first, and last on the way back).
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
MOST_TOKENS = 1 << 40
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, code in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(c: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def expanded(p: Column, patch=14, per_second=25.0, per_page=512) -> Column:
    """Tokens that an attachment stands for; unknown sizes count as one token."""
    at_least_0 = lambda x: F.greatest(x, F.lit(0))
    side = lambda x: F.ceil(at_least_0(F.coalesce(p[x], F.lit(1)).cast("double")) / patch)
    seconds = F.coalesce(F.nanvl(p["seconds"], F.lit(0.0)), F.lit(0.0))
    tokens = (
        F.when(p["kind"] == "image", (side("width") * side("height")).cast("double"))
        .when(p["kind"] == "audio", at_least_0(seconds) * per_second)
        .otherwise(at_least_0(F.coalesce(p["pages"], F.lit(0)).cast("double")) * per_page)
    )
    return F.ceil(F.least(tokens, F.lit(float(MOST_TOKENS)))).cast("long")


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin("text", "image", "audio"), p["kind"]).otherwise(F.lit("document"))


def text_parts(c: Column) -> Column:
    """A plain text as a list of one part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(c, F.lit("")).alias("text"), *none))


def format_chats(turns: DataFrame, parts="parts", conv="conv_id", turn="turn", role="role", trained=("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, segments (its text in
    order as struct<text, loss>), attachments (struct<turn, part, kind, ref, tokens>) and
    expanded_tokens."""
    at = lambda c: F.col(f"`{c}`")
    rows = turns.select(at(conv).alias("conv_id"), at(turn).alias("turn"), F.coalesce(at(role), F.lit("")).alias("role"), F.coalesce(at(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    rows = rows.withColumn("ordinal", F.row_number().over(order))

    def write(p, i):
        mark = F.concat(F.lit("<|"), _kind(p), F.lit(" "), F.col("ordinal").cast("string"), F.lit("."), i.cast("string"), F.lit("|>"))
        return F.when(p["kind"] == "text", escape(p["text"])).otherwise(mark)

    def attachment(p, i):
        return F.struct(F.col("ordinal").alias("turn"), i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"))

    rows = rows.select(
        "conv_id", "ordinal",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        F.array_join(F.transform("parts", write), "").alias("body"),
        F.col("role").isin(*trained).alias("loss"),
        F.filter(F.transform("parts", attachment), lambda a: a["kind"] != "text").alias("attachments"),
    )
    told = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "head", "body", "loss", "attachments"))).alias("t"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["loss"]), segment(F.lit(END), F.lit(False)))))
    attachments = F.flatten(F.transform("t", lambda x: x["attachments"]))
    return told.select("conv_id", F.size("t").cast("long").alias("n_turns"), segments.alias("segments"), attachments.alias("attachments")).select(
        "conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text, as an array of struct<role, text>."""
    def turn(x):
        text = F.substr(x, F.length(F.substring_index(x, TEXT, 1)) + F.lit(len(TEXT) + 1))
        return F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.substring_index(text, END, 1)).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != ""), turn)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
