"""Chat formatting by event-sourced reconstruction: a log of opened messages, streamed deltas, edits and regenerations is folded into final
messages, which are rendered turn by turn with a loss mask and can be read back.

The log is partitioned by conversation and message and sorted by sequence.  A message's text is what was streamed since its last edit or
regeneration; an edit brings a whole text, a regeneration discards what came before, a deletion hides the message unless an edit or
regeneration follows.  Turns are rendered row by row, so a conversation of any length is never held at once; it is the concatenation of its
turns in order.

A turn is ``<s>role``, a line break, the text and ``</s>``.  Control strings inside texts and roles get a backslash after their first character, those
that have backslashes there already get one more, so every text is read back as it was and no control string stands inside one.

Defined results: null texts are empty, null roles the empty role; turns with equal sequence are ordered by role and text; repeated rows are turns
of their own; rows without a conversation form one conversation with a null id; an empty table gives an empty one; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
TRAINED = "assistant"
#: Control strings by first character, backslashes and the rest; they cover <s>, </s>, <<SYS>>, <</SYS>>, [INST] and [/INST].
CONTROL = (("<", r"(/?(?:s|SYS)>)"), ("[", r"(/?INST\])"))
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"\{first}(\\*)" + rest, rf"\{first}$1\\$2")
    return text


def escaped_role(role: Column) -> Column:
    """Also keeps a role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    for first, rest in CONTROL:
        text = re.sub(rf"\{first}\\(\\*)" + rest, lambda m, first=first: first + m[1] + m[2], text)
    return text


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def as_events(rows: DataFrame) -> DataFrame:
    """The log of a table of finished turns ``(conv_id, turn, role, text)``: each row opens a message and streams its text."""
    numbered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.monotonically_increasing_id().alias("message"), "role", "text")
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.lit("open").alias("kind"), F.col("role"), none.alias("text")), F.struct(F.lit("delta").alias("kind"), none.alias("role"), F.col("text")))
    return numbered.select("conv_id", "seq", "message", F.explode(both).alias("_e")).select("conv_id", "seq", "message", "_e.*")


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, seq, role, text)``: the final messages of a log, ``seq`` being that of a message's first event.

    Events of one message meet, not those of one conversation.  Events of equal sequence apply in the order open, delta, regenerate, edit, delete.
    """
    order = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "delta", 1).when(F.col("kind") == "regenerate", 2).when(F.col("kind") == "edit", 3).otherwise(4)
    each = events.withColumn("_at", F.struct("seq", order.alias("k")))
    resets = F.col("kind").isin("edit", "regenerate")
    grouped = each.groupBy("conv_id", "message").agg(
        F.min("seq").alias("seq"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("_at"))).alias("role"),
        F.max(F.when(resets, F.col("_at"))).alias("_reset"), F.max(F.when(F.col("kind") == "delete", F.col("_at"))).alias("_deleted"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("_at", F.coalesce("text", F.lit("")).alias("text"))))).alias("_parts"),
    )
    alive = F.col("_deleted").isNull() | (F.col("_reset").isNotNull() & (F.col("_reset") > F.col("_deleted")))
    kept = F.filter("_parts", lambda p: F.col("_reset").isNull() | (p["_at"] >= F.col("_reset")))
    text = F.array_join(F.transform(kept, lambda p: p["text"]), "")
    return grouped.where(alive).select("conv_id", "seq", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``(conv_id, seq, role, formatted, loss_start, loss_end)``: each turn's text in the template, and which of its characters are trained on."""
    head = F.concat(F.lit(BEGIN), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    learn = F.col("role") == trained
    start = F.when(learn, F.length(head).cast("long"))
    return messages.select("conv_id", "seq", "role", F.concat(head, body, F.lit(END)).alias("formatted"), start.alias("loss_start"), (start + F.length(body)).alias("loss_end"))


def in_order(rendered: DataFrame) -> DataFrame:
    """Each conversation's turns after one another, in one partition."""
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("seq"), "role", "formatted")


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    if not (formatted.startswith(BEGIN) and formatted.endswith(END)):
        raise ValueError("not a rendered turn")
    role, _, text = formatted[len(BEGIN) : -len(END)].partition("\n")
    return unescape_role(role), unescape(text)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted turns; only the running digests of one conversation are held."""
    made: list[tuple] = []
    current, turns, loss, n, loss_chars, chars = None, None, None, 0, 0, 0

    def close() -> None:
        made.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def out() -> pa.RecordBatch:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)
        made.clear()
        return batch

    for part in batches:
        rows = zip(part.column("conv_id").to_pylist(), part.column("formatted").to_pylist(), part.column("loss_start").to_pylist(), part.column("loss_end").to_pylist(), strict=True)
        for conv, formatted, start, end in rows:
            if turns is None or conv != current:
                if turns is not None:
                    close()
                current, turns, loss, n, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, text = parse(formatted)
            turns.update(f"{role}\n{text}\n".encode())
            n, chars = n + 1, chars + len(formatted)
            if start is not None:
                learned = unescape(formatted[start:end])
                loss.update(learned.encode())
                loss_chars += len(learned)
        if made:
            yield out()
    if turns is not None:
        close()
        yield out()


def digests(rendered: DataFrame) -> DataFrame:
    """What is read back from the rendered conversations, by conversation."""
    return in_order(rendered).select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digest, DIGEST)


def write(rendered: DataFrame, path: str) -> None:
    """Rendered turns as Parquet, each conversation in order within one file."""
    in_order(rendered).write.parquet(path)
