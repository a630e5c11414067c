"""Chat formatting by event sourcing: fold a log of deltas, edits and regenerations into messages, then render.

Everything is a DataFrame expression.  Template of a turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts a backslash becomes two, and ``<|`` becomes ``<\\|``; a role's line feed becomes ``\\n``
written out.  So a control string can only come from the template, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Odd pieces between escaped backslashes are plain, so "\\n" inside "\\\\n" is not touched.
    return F.array_join(F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv, message, role, text) of an event log.

    ``log`` has conv (any type), message (orderable; the place in the conversation), seq (orderable; the time),
    kind, role and text; further columns are ignored.  Kinds: ``message`` and ``edit`` set the whole text,
    ``regenerate`` clears it, ``delta`` appends to what the last of these left, ``delete`` removes the message
    until something follows it; an unknown or null kind counts as ``message``.  Null texts are empty, the last
    non-null role counts ("" if there is none).  Events with equal seq are taken in the order of kind
    (deltas last), role and text.  A null conv is a conversation of its own.
    """
    kind = F.lower(F.coalesce("kind", F.lit("message")))
    kind = F.when(kind.isin("message", "edit", "regenerate", "delta", "delete"), kind).otherwise("message")
    e = log.select(F.col("conv").alias("conv"), F.col("message").alias("message"), F.struct(
        F.col("seq").alias("seq"), (kind == "delta").cast("int").alias("later"), kind.alias("kind"),
        F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("event"))
    grouped = e.groupBy("conv", "message").agg(F.sort_array(F.collect_list("event")).alias("events"))
    # The deltas after the last event that sets or clears the text are joined at once, not one by one.
    last = F.aggregate(
        F.transform("events", lambda x, i: F.when(x["kind"] != "delta", i + 1).otherwise(F.lit(0))),
        F.lit(0), lambda a, x: F.greatest(a, x))
    grouped = grouped.withColumn("last", last).withColumn(
        "tail", F.slice("events", F.greatest(F.col("last"), F.lit(1)), F.size("events")))
    head = F.col("tail")[0]
    clears = lambda x: x["kind"].isin("regenerate", "delete")
    text = F.array_join(F.transform("tail", lambda x: F.when(clears(x), "").otherwise(x["text"])), "")
    roles = F.filter(F.transform("events", lambda x: x["role"]), lambda r: r.isNotNull())
    return grouped.where(~((head["kind"] == "delete") & (F.size("tail") == 1))).select(
        "conv", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, n_turns, formatted, mask) per conversation.

    ``mask`` has an entry per turn: ``skip``, the code points of the turn's header, ``chars``, those of its
    escaped text, and ``train``, whether the loss counts there.  Turns are ordered by message, then role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = escape(text)
    header = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turn = messages.select(F.col("conv").alias("conv"), F.struct(
        F.col("message").alias("message"), role.alias("role"), F.concat(header, body, F.lit(END + "\n")).alias("piece"),
        F.struct(F.length(header).alias("skip"), F.length(body).alias("chars"), role.isin(*train_roles).alias("train")).alias("mask")).alias("turn"))
    return (turn.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv", F.size("turns").cast("long").alias("n_turns"),
                    F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                    F.transform("turns", lambda t: t["mask"]).alias("mask")))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv, turns, loss_text, formatted) parsed from ``formatted`` and ``mask`` alone.

    ``turns`` holds role and text of each turn; ``loss_text`` joins what stands under the mask, unescaped.
    """
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    got = rendered.select("conv", "formatted", "mask", parts.alias("parts"))
    def turn(p: Column) -> Column:
        cut = F.locate("\n", p)
        tail = F.substr(p, cut + 1)
        return F.struct(unescape_role(F.substr(p, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substr(tail, F.lit(1), F.length(tail) - len(END) - 1)).alias("text"))

    def trained(p: Column, m: Column) -> Column:
        return F.when(m["train"], unescape(F.substr(p, m["skip"] - len(START) + 1, m["chars"]))).otherwise(F.lit(""))
    return got.select("conv", "formatted", F.transform("parts", turn).alias("turns"),
                      F.array_join(F.zip_with("parts", "mask", trained), "").alias("loss_text"))
