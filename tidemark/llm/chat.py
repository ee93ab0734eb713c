r"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar of a formatted conversation::

    conversation := mode turn*            mode := "<|raw|>\n" | "<|esc|>\n"
    turn         := "<|im_start|>" role "\n" text "<|im_end|>\n"     (no marker inside role or text)

Texts go in as they are (mode raw). The result is parsed again by the grammar; where the parsed turns differ from the source,
that conversation is formatted in mode esc: backslashes are doubled, ``<|`` becomes ``<\|`` and a line feed in a role becomes a
backslash before it. That is parsed and compared again, and ``identical`` tells the outcome.

Null texts and roles are empty. Turns are ordered by turn, then role, then text; a null turn is first, repeated rows stay. Rows
with a null conv_id form one conversation. A conversation is one value by definition, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import parted

START, END, RAW, ESC = "<|im_start|>", "<|im_end|>\n", "<|raw|>\n", "<|esc|>\n"


def _escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def render(turns: Column, escaped: bool) -> Column:
    """The text of array<struct<role,text>>."""
    role = lambda t: F.replace(_escape(t["role"]), F.lit("\n"), F.lit("\\\n")) if escaped else t["role"]
    text = lambda t: _escape(t["text"]) if escaped else t["text"]
    parts = F.transform(turns, lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), text(t), F.lit(END)))
    return F.concat(F.lit(ESC if escaped else RAW), F.array_join(parts, ""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; pieces that break the grammar give a null role."""
    esc = formatted.startswith(ESC)
    pieces = F.split(F.substr(formatted, F.lit(len(RAW) + 1)), r"<\|im_start\|>")

    def turn(x: Column) -> Column:
        head = F.when(esc, F.regexp_extract(x, r"\A((?:[^\\\n]|(?s:\\.))*+)\n", 1)).otherwise(F.substring_index(x, "\n", 1))
        body = F.substr(x, F.char_length(head) + 2)
        ok = x.endswith(END) & ~F.contains(F.substr(body, F.lit(1), F.greatest(F.char_length(body) - len(END), F.lit(0))), F.lit("<|im_end|>"))
        body = F.when(ok, F.substr(body, F.lit(1), F.greatest(F.char_length(body) - len(END), F.lit(0))))
        return F.struct(F.when(ok, F.when(esc, _unescape(head)).otherwise(head)).alias("role"), F.when(esc, _unescape(body)).otherwise(body).alias("text"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (parsed back from it), identical."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # compute on rows that AQE doesn't merge into a few tasks: formatting is the work, not the shuffle
    by = conversations.repartition(parted(conversations.sparkSession), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    by = by.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    raw = by.select("*", render(F.col("source"), False).alias("raw"))
    raw = raw.select("conv_id", "source", F.when(parse(F.col("raw")) == F.col("source"), F.col("raw")).otherwise(render(F.col("source"), True)).alias("formatted"))
    return raw.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), "source").select("conv_id", "formatted", "turns", (F.col("turns") == F.col("source")).alias("identical"))


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, identical."""
    f = formatted(conversations.select("conv_id", "turn", "role", "text"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
