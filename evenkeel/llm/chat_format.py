"""Chat formatting from event logs: streamed deltas, edits and regenerations are folded into messages, then rendered.

An event is ``conv_id, seq, message, kind, role, text``. Kinds, in the order in which equal numbers ``seq`` are folded:

* ``start``: the message begins, empty, in a role;
* ``edit``: its text becomes this text;
* ``regenerate``: its text becomes empty, and messages after it that had started by then are dropped;
* ``delta``: this text is appended.

Folding works message by message, so a conversation with very many events is spread over tasks by its messages. Which
branches a regeneration dropped, and the order of turns, need a conversation's messages side by side; there Spark's
window goes through them in order and spills what it cannot hold. Rendering is a column expression per message. The
formatted text of a conversation is its parts in order (one part a message, the first with the opening mark), so no
task ever holds a whole conversation.

Template: ``<s>`` opens a conversation; a user's turn is ``[INST] … [/INST]``, a system's ``<<SYS>>…<</SYS>>``, an
assistant's ``…</s>``, any other role's ``[ROLE name]…[/ROLE]``. Where a text holds such a mark, one more backslash
enters after its first character (``[INST]`` reads ``[\\INST]``, ``[\\INST]`` reads ``[\\\\INST]``), so no text can
close or open a turn, and taking one backslash away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

OPENING = "<s>"
USER, USER_END = "[INST] ", " [/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
ASSISTANT_END = "</s>"
OTHER, NAMED, OTHER_END = "[ROLE ", "]", "[/ROLE]"
KINDS = ("start", "edit", "regenerate", "delta")

# a mark is its first character and one of these endings; the opening character is matched apart from backslashes
MARKS = r"/?s>|/?INST\]|</?SYS>>|ROLE |/ROLE\]"
PLAIN, ESCAPED = rf"([<\[])(\\*)({MARKS})", rf"([<\[])\\(\\*)({MARKS})"
NAME_CODES = (("%", "%25"), ("]", "%5D"), ("[", "%5B"), ("<", "%3C"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1$2\\$3")


def role_name(role: Column, back: bool = False) -> Column:
    for sign, code in reversed(NAME_CODES) if back else NAME_CODES:
        role = F.replace(role, F.lit(code if back else sign), F.lit(sign if back else code))
    return role


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text``: one row per message that stands at the end of its log.

    Logs may deliver an event twice; equal deltas of one number count once. Null text is empty; an unknown kind, or a
    null message, kind or number, is no event. A message has the role of its last start, else the last one named, else
    an empty one; one that only has deltas stands as well. A null conv_id is a conversation of its own. An empty log gives no rows; other columns are ignored.
    """
    kind = F.col("kind")
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    rows = events.filter(kind.isin(*KINDS) & F.col("message").isNotNull() & F.col("seq").isNotNull()).select(
        "conv_id", "message", "seq", "kind", "role", order.alias("order"), F.coalesce("text", F.lit("")).alias("text")
    )
    base = F.struct("seq", "order", F.when(kind == "edit", F.col("text")).otherwise("").alias("text"))
    folded = rows.groupBy("conv_id", "message").agg(
        F.max(F.when(kind != "delta", base)).alias("base"),
        F.collect_set(F.when(kind == "delta", F.struct("seq", "text"))).alias("deltas"),
        F.coalesce(
            F.max(F.when(kind == "start", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"))))["role"],
            F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "order", "role")))["role"],
        ).alias("role"),
        F.coalesce(F.max(F.when(kind == "start", F.col("seq"))), F.min("seq")).alias("started"),
        F.max(F.when(kind == "regenerate", F.col("seq"))).alias("cut"),
    )
    later = F.filter(F.array_sort("deltas"), lambda d: F.col("base").isNull() | (d["seq"] >= F.col("base")["seq"]))
    text = F.concat(F.coalesce(F.col("base")["text"], F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    messages = folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), "started", "cut")
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    last_cut = F.max("cut").over(earlier)
    standing = messages.withColumn("last_cut", last_cut).filter(F.col("last_cut").isNull() | (F.col("started") > F.col("last_cut")))
    return standing.select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_start, loss_end`` of ``messages(conv_id, message, role, text)``.

    ``part`` counts a conversation's messages from 0; its formatted text is its parts joined in that order. The loss
    mask is the code points ``loss_start`` to ``loss_end`` (exclusive) of a part: an assistant's text, else nothing.
    Null texts and roles are empty; equal messages are ordered by role and text. An empty table gives no rows.
    """
    told = messages.select(
        "conv_id", "message", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    ).withColumn("part", F.row_number().over(Window.partitionBy("conv_id").orderBy("message", "role", "text")) - 1)
    role, body = F.col("role"), F.col("body")
    before = (
        F.when(role == "user", USER)
        .when(role == "system", SYSTEM)
        .when(role == "assistant", "")
        .otherwise(F.concat(F.lit(OTHER), role_name(role), F.lit(NAMED)))
    )
    after = (
        F.when(role == "user", USER_END)
        .when(role == "system", SYSTEM_END)
        .when(role == "assistant", ASSISTANT_END)
        .otherwise(OTHER_END)
    )
    opened = F.when(F.col("part") == 0, OPENING).otherwise("")
    parts = told.withColumn("body", escaped(F.col("text"))).select(
        "conv_id", "part", F.concat(opened, before).alias("before"), "body", after.alias("after"), "role"
    )
    start = F.char_length("before")
    spoken = F.when(role == "assistant", F.char_length("body")).otherwise(0)
    return parts.select(
        "conv_id", F.col("part").cast("long").alias("part"), F.concat("before", body, "after").alias("formatted"),
        start.cast("long").alias("loss_start"), (start + spoken).cast("long").alias("loss_end"),
    )


def joined(parts: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: one row per conversation, spans in its own code points.

    For conversations that fit a cell; longer ones are read part by part.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "formatted", "loss_start", "loss_end")))
    rows = parts.groupBy("conv_id").agg(ordered.alias("p"))
    spans = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["formatted"])).cast("long").alias("at"),
            F.when(
                p["loss_end"] > p["loss_start"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + p["loss_start"]).alias("start"), (s["at"] + p["loss_end"]).alias("end")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return rows.select("conv_id", F.array_join(F.transform("p", lambda p: p["formatted"]), "").alias("formatted"), spans["spans"].alias("loss"))


UNESCAPE = re.compile(ESCAPED)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text, whole or from the start of some turn."""
    at = len(OPENING) if formatted.startswith(OPENING) else 0
    while at < len(formatted):
        if formatted.startswith(USER, at):
            role, start, end = "user", at + len(USER), USER_END
        elif formatted.startswith(SYSTEM, at):
            role, start, end = "system", at + len(SYSTEM), SYSTEM_END
        elif formatted.startswith(OTHER, at):
            start, end = formatted.index(NAMED, at) + 1, OTHER_END
            role = formatted[at + len(OTHER) : start - 1]
            for sign, code in reversed(NAME_CODES):
                role = role.replace(code, sign)
        else:
            role, start, end = "assistant", at, ASSISTANT_END
        stop = formatted.index(end, start)
        yield role, unescaped(formatted[start:stop])
        at = stop + len(end)


def read_back(parts: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, parsed from the formatted text.

    A task goes through its conversations part by part and holds one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, n, loss, chars = False, None, 0, 0, 0
        told, said = hashlib.sha256(), hashlib.sha256()
        rows: list[tuple] = []
        shape = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                 ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, shape, strict=True)], [x for x, _ in shape])

        for batch in batches:
            names = ("conv_id", "formatted", "loss_start", "loss_end")
            columns = [batch.column(c).to_pylist() for c in names]
            for now, formatted, start, end in zip(*columns, strict=True):
                if not open_ or now != conv:
                    if open_:
                        rows.append((conv, n, told.hexdigest(), loss, said.hexdigest(), chars))
                    open_, conv, n, loss, chars = True, now, 0, 0, 0
                    told, said = hashlib.sha256(), hashlib.sha256()
                for role, text in turns(formatted):
                    n += 1
                    told.update(f"{role}\n{text}\n".encode())
                under = unescaped(formatted[start:end])
                said.update(under.encode())
                loss += len(under)
                chars += len(formatted)
            if len(rows) > 1000:
                yield batch_of()
                rows.clear()
        if open_:
            rows.append((conv, n, told.hexdigest(), loss, said.hexdigest(), chars))
        if rows:
            yield batch_of()

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, shape)


def logged(conversations: DataFrame) -> DataFrame:
    """An event log whose fold is ``conversations(conv_id, turn, role, text)``.

    Every turn streams in pieces cut by a hash of its place. Some begin with a draft that an edit replaces; some
    assistants are regenerated after a draft and a next turn that goes with it. Rows are messages by turn, equal turns by role
    and text; repeated rows are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    h, long = F.pmod(F.xxhash64("conv_id", "message"), F.lit(1 << 30)), F.char_length("text")
    rows = rows.withColumns({"h": h, "a": (h % (long + 1)).cast("int")}).withColumn("b", F.col("a") + ((F.col("h") / 7).cast("int") % (long - F.col("a") + 1)).cast("int"))
    role = F.col("role")

    def event(at: int, kind: str, text: Column, message: int = 0, own: Column | None = None) -> Column:
        return F.struct(
            (F.col("message") * 16 + at).alias("seq"), (F.col("message") + message).alias("message"), F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if own is None else own).alias("role"), text.alias("text"),
        )

    none, empty = F.lit(None).cast("string"), F.array().cast("array<struct<seq:long,message:long,kind:string,role:string,text:string>>")
    draft = F.concat(F.left(F.col("text"), F.lit(20)), F.lit(" </s>"))
    start = F.array(event(0, "start", none, own=role))
    again = F.array(
        event(1, "delta", draft), event(2, "start", none, 1, F.lit("user")), event(3, "delta", draft, 1), event(4, "regenerate", none)
    )
    begun = F.when((role == "assistant") & (F.col("h") % 5 == 0), again).otherwise(empty)
    pieces = F.array(
        event(5, "delta", F.left("text", F.col("a"))),
        event(6, "delta", F.substr("text", F.col("a") + 1, F.col("b") - F.col("a"))),
        event(7, "delta", F.substr("text", F.col("b") + 1)),
    )
    edited = F.array(event(5, "delta", draft), event(6, "edit", F.left("text", F.col("a"))), event(7, "delta", F.substr("text", F.col("a") + 1)))
    written = F.when(F.col("h") % 7 == 3, edited).otherwise(pieces)
    return rows.select("conv_id", F.explode(F.concat(start, begun, written)).alias("e")).select("conv_id", "e.*")
