"""Chat formatting by event-sourced reconstruction.

A log holds events of messages: ``open`` (role, first text), ``delta`` (text streamed on), ``edit`` (the text
is replaced), ``regenerate`` (the text is thrown away and streamed anew) and ``delete``. Folding a message's events
by sequence gives the final message; every message is then rendered in a template that marks turns and
escapes control strings, with the span of each assistant text as loss mask.

A message is folded alone, so rows are dealt by conversation and turn: a conversation with very many turns is
spread over tasks, and a task holds one message at a time. The formatted conversation is the pieces of its
turns in order. Reading back streams those pieces by conversation through running digests.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The template. A turn is OPEN role SEPARATOR text CLOSE.
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
DELTA = 4096
LEARNED = "assistant"
IN_TEXT = re.compile(r"\\|#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(r"[\\:]|#(?=##)|<(?=/turn>)")
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
KEYS = ("conv_id", "turn", "message")


def escape(text: str, what: re.Pattern = IN_TEXT) -> str:
    """A backslash before every backslash and before what could be read as a control string."""
    return what.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and the span of its text in code points."""
    head, body = OPEN + escape(role, IN_ROLE) + SEPARATOR, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str):
    """The (role, text) of every turn of a formatted text."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def fold(events):
    """The final (role, text) of one message from its (kind, role, text) in sequence; None if it was deleted.

    Null texts add nothing. The role is the first one given, empty if none is.
    """
    role, parts, there = None, [], False
    for kind, r, text in events:
        role = r if role is None else role
        there = kind != "delete"
        if kind in ("edit", "regenerate", "delete"):
            parts = []
        elif kind not in ("open", "delta"):
            raise ValueError(f"unknown kind of event: {kind!r}")
        if kind != "delete":
            parts.append(text or "")
    return (role or "", "".join(parts)) if there else None


def events_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of stored messages: each row is opened and its text streamed in deltas of at most DELTA code points.

    Rows of the same conversation and turn stay messages of their own, ordered by role, then a hash of the text.
    """
    body, who = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{role}`").cast("string")
    message = F.concat_ws("|", F.coalesce(who, F.lit("")), F.hex(F.xxhash64(body)), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    rows = conversations.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), message.alias("message"), who.alias("role"),
                                F.regexp_extract_all(body, F.lit(f"(?s).{{1,{DELTA}}}+"), 0).alias("deltas"))
    events = F.concat(F.array(F.lit("")), "deltas")
    return rows.select(*KEYS, "role", F.posexplode(events).alias("seq", "text")).select(
        *KEYS, "seq", F.when(F.col("seq") == 0, "open").otherwise("delta").alias("kind"), "role", "text")


def with_detours(log: DataFrame) -> DataFrame:
    """The same messages by a longer way, as logs of real conversations have it: every assistant's message is begun,
    thrown away and regenerated, every other one is mistyped and edited, and each has a twin that is deleted. The
    detours are made of the messages' own first events, so they grow with the log; folding must undo them all."""
    events = log.withColumn("seq", F.col("seq") * 4)
    opened = events.filter("kind = 'open'").withColumn("first", F.concat(F.coalesce("role", F.lit("")), F.lit(" \\ ### </turn>")))
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    again = F.when(F.col("role") == LEARNED, "regenerate").otherwise("edit")
    inside = F.array(event(1, "delta", F.col("first")), F.struct(F.lit(2).alias("seq"), again.alias("kind"), F.lit(None).cast("string").alias("text")))
    gone = F.array(event(0, "open", F.lit("")), event(1, "delta", F.col("first")), event(2, "delete", F.lit(None)))
    of = lambda frame, made: frame.select(*KEYS, "role", F.inline(made)).select(*KEYS, "seq", "kind", "role", "text")
    twins = opened.withColumn("message", F.concat(F.lit("deleted|"), "message"))
    return events.unionByName(of(opened, inside)).unionByName(of(twins, gone))


def format_log(log: DataFrame) -> DataFrame:
    """``conv_id, turn, message, formatted, loss_begin, loss_end``: a row per final message of the log (columns
    ``conv_id, turn, message, seq, kind, role, text``). A null conversation is a conversation, a null turn
    comes first; the loss span is null where nothing is learned. Events that tie in ``seq`` go by kind and text."""
    kinds = [log.schema[k].dataType.simpleString() for k in KEYS]
    dealt = log.select(*KEYS, "seq", "kind", "role", "text").repartition("conv_id", "turn").sortWithinPartitions(*KEYS, "seq", "kind", "text")

    def run(batches):
        types, now, events, out = None, None, [], []

        def close():
            final = fold(events)
            if final is not None:
                formatted, begin, end = render(*final)
                learned = final[0] == LEARNED
                out.append((*now, formatted, begin if learned else None, end if learned else None))

        def batch_of():
            columns = list(zip(*out)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, [*types, pa.string(), pa.int64(), pa.int64()])]
            return pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "formatted", "loss_begin", "loss_end"])

        for batch in batches:
            types = [batch.column(i).type for i in range(3)]
            for *key, _, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now and events:
                    close()
                    events = []
                now = key
                events.append((kind, role, text))
            yield batch_of()
            out.clear()
        if events:
            close()
            yield batch_of()

    return dealt.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in zip(KEYS, kinds)) + ", formatted string, loss_begin bigint, loss_end bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. Pieces stream in order through running digests; no conversation is held."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions(*KEYS)

    def run(batches):
        conv, state, type_ = None, None, None

        def row():
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size), (type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            type_ = batch.column(0).type
            for c, text, begin, end in zip(*(x.to_pylist() for x in batch.columns)):
                if state is not None and c != conv:
                    yield row()
                    state = None
                if state is None:
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if begin is not None:
                    learned = unescape(text[begin:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
        if state is not None:
            yield row()

    return ordered.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
