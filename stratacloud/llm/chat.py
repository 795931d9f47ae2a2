"""Chat formatting with typed content parts, in DataFrame operations only.

A message is an array of parts: text, image, audio or document.  The visitor turns text into
escaped text and every other part into a placeholder, in order, and records what the
placeholder stands for and how many tokens it expands to.  Control strings all begin with
"<", which escaped text never holds, and a kind that isn't known stands escaped after a marker of
its own, so that it can't forge one: a formatted conversation reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm._common import text_or_empty

PART = "struct<kind:string,text:string,ref:string,amount:double>"
TURN, CLOSE, END, OTHER = "<turn ", ">", "</turn>\n", "<part "
#: Tokens that a unit of `amount` expands to: image pixels, seconds of sound, document pages.
TOKENS = {"image": 1 / 784.0, "audio": 25.0, "document": 600.0}


def escape(text: Column) -> Column:
    """Reversible: no "<" or ">" is left, and "&" only begins an escape."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text_or_empty(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def part_tokens(part: Column) -> Column:
    """Expanded tokens of an attachment, at least 1; 0 for text and for kinds that are not known."""
    out = F.lit(0)
    for kind, rate in TOKENS.items():
        out = F.when(part["kind"] == kind, F.greatest(F.lit(1), F.ceil(F.coalesce(part["amount"], F.lit(0.0)) * rate))).otherwise(out)
    return out.cast("long")


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"] != "text", F.lit(False))


def placeholder(part: Column) -> Column:
    """<image>, <audio>, <document>; <part kind> for any other kind, escaped."""
    known = part["kind"].isin(*TOKENS)
    return F.when(known, F.concat(F.lit("<"), part["kind"], F.lit(">"))).otherwise(F.concat(F.lit(OTHER), escape(part["kind"]), F.lit(CLOSE)))


def format_messages(messages: DataFrame) -> DataFrame:
    """One row for each conv_id: formatted, n_turns, loss_spans, attachments, expanded_tokens.

    messages needs conv_id, turn, role and parts (array of PART).  Turns are ordered by
    turn, null first, then by role and content; repeated rows are turns of their own.  Null
    role and text read as empty, a null or empty message has no content, a null kind reads as text.  loss_spans are
    (start from 0, length) of the content of assistant turns, in code points of `formatted`;
    attachments number from 0 within the conversation.  A formatted conversation is one
    value, so its turns meet in one row; nothing else is gathered.  An empty table gives
    an empty result.
    """
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    content = F.array_join(F.transform(parts, lambda p: F.when(_is_attachment(p), placeholder(p)).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    role = F.coalesce(F.col("role"), F.lit(""))
    found = F.transform(F.filter(parts, _is_attachment), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    written = F.concat(F.lit(TURN), escape(role), F.lit(CLOSE), content, F.lit(END))
    turns = messages.select("conv_id", "turn", role.alias("role"), content.alias("content"), found.alias("found"), written.alias("written"))
    # where each turn begins: a running sum over the conversation, dealt out as the rows that it is gathered into
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "found").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.char_length("written").cast("long")).over(order), F.lit(0)))
    body = F.struct((F.col("at") + F.char_length(F.concat(F.lit(TURN), escape(F.col("role")), F.lit(CLOSE)))).cast("int").alias("start"), F.char_length("content").alias("length"))
    # "at" alone puts the turns in order: every written turn has some length
    turn = F.struct("at", (F.col("role") == "assistant").alias("learn"), body.alias("span"), "written", "found")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["found"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"),
        F.transform(attachments, lambda a, i: F.struct(i.alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("expanded_tokens"),
    )


def parse_formatted(formatted: str | Column = "formatted") -> Column:
    """Turns read back from formatted text: array of struct(role, content), content still escaped."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    turns = F.filter(F.split(column, END), lambda s: s != "")
    body = lambda s: F.substr(s, F.lit(len(TURN) + 1))
    return F.transform(turns, lambda s: F.struct(unescape(F.substring_index(body(s), CLOSE, 1)).alias("role"), F.substr(body(s), F.length(F.substring_index(body(s), CLOSE, 1)) + 2).alias("content")))


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """Unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["length"]))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the output of format_messages()."""
    turns = parse_formatted()
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n"))), "")
    return formatted.withColumn("loss", masked_text()).select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )
