"""Chat transcripts from event logs: fold, render, read back.

An event has ``conv_id, seq, kind, slot, role, text``. Slots are the positions of messages. Kinds:

* ``message``: the whole text of a slot;
* ``delta``: a piece that is appended to its slot, as a stream gave it;
* ``edit``: a new whole text of a slot; later messages stay;
* ``regenerate``: the slot starts anew (with this event's text, then further deltas) and every message
  in a later slot that was logged before it is gone.

Logs are partitioned by conversation and sorted by sequence; running windows, which spill, tell which
events still count; the pieces of one message are joined by a plain aggregation, so a conversation is
never held in memory. Rendering is one row per message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template: control strings and where they stand.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Control strings in texts get a backslash after their first character; one that has backslashes there gets one more.
_INSIDE = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)(?={_INSIDE})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_INSIDE})"
OPEN, CLOSE, NEXT = "<s>", "</s>", "[/INST]"


def escape(text: Column) -> Column:
    """Text in which no control string is left."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape_text(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2", text)


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, slot, role, text`` of a log.

    Null text is empty; a null role is ``user``; events without conv_id, seq or slot are ignored, as are unknown
    kinds. Equal seq values are ordered by kind, then by text; fully equal events count once.
    """
    kinds = F.col("kind").isin("message", "delta", "edit", "regenerate")
    e = events.where(kinds & F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("slot").isNotNull())
    e = e.select("conv_id", "seq", "kind", "slot", F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    order = [F.col("seq").desc(), F.col("kind").desc(), F.col("text").desc()]
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("slot"))).over(later))
    e = e.where("cut is null or slot <= cut")
    e = e.withColumn("reset", F.max(F.col("kind") != "delta").over(same)).where("reset is null or not reset")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda x: x["text"])
    return e.groupBy("conv_id", "slot").agg(F.max_by("role", F.struct("seq", "kind")).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One segment per message: ``conv_id, slot, segment, loss_from, loss_len``.

    A segment is ``<s>`` role ``[INST]`` text ``[/INST]`` escaped, or for an assistant ``<s>`` role ``[/INST]`` text
    ``</s>``. The loss mask covers the text of assistant messages: ``loss_len`` code points from ``loss_from`` on. The whole
    conversation is its segments in slot order, nothing between.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    mine = F.col("role") == "assistant"
    head = F.concat(F.lit(OPEN), role, F.when(mine, F.lit(NEXT)).otherwise(F.lit("[INST]")))
    segment = F.concat(head, text, F.when(mine, F.lit(CLOSE)).otherwise(F.lit(NEXT)))
    return messages.select("conv_id", "slot", segment.alias("segment"), F.length(head).alias("loss_from"), F.when(mine, F.length(text)).otherwise(0).alias("loss_len"))


_SEGMENT = re.compile(r"<s>(.*?)(?:\[INST\](.*)\[/INST\]|\[/INST\](.*)</s>)", re.S)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of one segment, unescaped."""
    m = _SEGMENT.fullmatch(segment)
    return unescape_text(m[1]), unescape_text(m[2] if m[2] is not None else m[3])


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from segments that come sorted by conversation and slot; holds one segment at a time."""
    now, turns, loss, counts = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

    def row() -> list:
        return [now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]

    for batch in it:
        done = []
        for conv, segment, start, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if conv != now:
                if now is not None:
                    done.append(row())
                now, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text = parse_segment(segment)
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape_text(segment[start : start + size])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            counts = [counts[0] + 1, counts[1] + len(masked), counts[2] + len(segment)]
        yield _rows(done)
    if now is not None:
        yield _rows([row()])


NAMES = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
KINDS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=NAMES)


def read_back(segments: DataFrame) -> DataFrame:
    """What a reader finds in rendered conversations: turns, digests of all turns and of the text under the loss mask.

    One task reads a conversation in order, since a digest is sequential; it streams segments and holds one.
    """
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "slot").mapInArrow(_read, KINDS)


def events_of(conversations: DataFrame, piece: int = 200) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text): users send messages, assistants stream deltas.

    By a rule of conv_id and position, every third message that is no answer was sent as a draft and then edited, and every fourth answer
    was begun wrongly, followed by a message, and then regenerated. Folding the log gives the conversation back.

    Rows are by turn; of rows with the same conv_id and turn each is a message of its own, in order of role and text,
    so nothing is lost. Null turns come first. Rows without conv_id are ignored.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    slot = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    c = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    c = c.withColumn("slot", slot).withColumn("streamed", F.coalesce(F.col("role") == "assistant", F.lit(False)))
    turn = F.col("conv_id") + F.col("slot")
    again, edited = F.col("streamed") & (F.pmod(turn, F.lit(4)) == 0), ~F.col("streamed") & (F.pmod(turn, F.lit(3)) == 0)
    event = lambda k, kind, at, role, text: F.struct(k.cast("long").alias("k"), kind.alias("kind"), at.alias("slot"), role.alias("role"), text.alias("text"))
    draft = event(F.lit(0), F.when(again, "delta").otherwise("message"), F.col("slot"), F.col("role"), F.lit("not this"))
    lost = event(F.lit(1), F.lit("message"), F.col("slot") + 1, F.lit("user"), F.lit("nor this"))
    before = F.when(again, F.array(draft, lost)).when(edited, F.array(draft)).otherwise(F.array().cast("array<struct<k:bigint,kind:string,slot:bigint,role:string,text:string>>"))
    count = F.when(F.col("streamed"), F.greatest(F.lit(1), F.ceil(F.length("text") / piece))).otherwise(F.lit(1)).cast("long")
    first = F.when(again, "regenerate").when(F.col("streamed"), "delta").when(edited, "edit").otherwise("message")
    c = c.withColumn("before", before).withColumn("first", first).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    part = F.when(F.col("streamed"), F.substring("text", (F.col("k") * piece + 1).cast("int"), F.lit(piece))).otherwise(F.col("text"))
    now = event(F.col("k") + 2, F.when(F.col("k") == 0, F.col("first")).otherwise("delta"), F.col("slot"), F.col("role"), part)
    every = c.select("conv_id", F.col("slot").alias("at"), F.explode(F.when(F.col("k") == 0, F.concat("before", F.array(now))).otherwise(F.array(now))).alias("e"))
    return every.select("conv_id", (F.col("at") * (1 << 32) + F.col("e.k")).alias("seq"), "e.kind", "e.slot", "e.role", "e.text")
