"""Chat formatting with a grammar round trip.

    turn   := "<s>[INST] " role " [/INST]" text "</s>"
    output := turn*

Each of the strings ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` is a control string; a
reader takes the first one that may follow.  In a role or a text that holds one,
a backslash is put behind its first character (``<\\/s>``), and one more where such
an escape is there already; the reader takes one away.  A turn is rendered as it
is, parsed, and compared with its source, and what comes back changed is escaped
and parsed again until it is the same.

A conversation is formatted in segments of bounded size, in order, so a very
long one never is in memory at once.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_defaults

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]))")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
#: Role whose texts are learned from.
LEARNED = "assistant"
#: Turns and characters after which a segment ends.
SEGMENT_TURNS, SEGMENT_CHARS = 64, 1 << 18


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


def parse(output: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the span of the text in ``output``, of each turn.  What is no sequence of turns is an error."""
    turns, at = [], 0
    while at < len(output):
        m = TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return turns


def same(output: str, turn: tuple[str, str]) -> bool:
    try:
        return [x[:2] for x in parse(output)] == [turn]
    except ValueError:
        return False


def render(turn: tuple[str, str]) -> str:
    """A turn that is parsed as its source; escaped only if it has to be."""
    role, text = turn
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        output = f"{OPEN}{r}{MIDDLE}{t}{CLOSE}"
        if same(output, turn):
            return output
    raise ValueError("a turn can't be told from the template")


def formatted(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id, segment, formatted, loss_spans: the segments of each conversation, and in each the spans of the learned texts.

    Turns are ordered by their number, then role and text; null numbers come
    first.  A null role or text is empty.  Repeated rows are turns of their own, and
    a null conv_id is a conversation like any other.  The rows of a conversation
    are together and in the order of its segments.  Other columns than the four
    are not read; an empty table gives no rows.
    """
    session_defaults(df.sparkSession)
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, number, parts, spans, size = None, -1, [], [], 0
        done: list[tuple] = []

        def close():
            done.append((conv, number, "".join(parts), list(spans)))
            parts.clear()
            spans.clear()

        def batch_of():
            columns = list(zip(*done, strict=True))
            done.clear()
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], span)], ["conv_id", "segment", "formatted", "loss_spans"])

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if parts and (c != conv or len(parts) >= SEGMENT_TURNS or size >= SEGMENT_CHARS):
                    close()
                    size, number = 0, number + 1 if c == conv else 0
                elif not parts:
                    number = 0
                conv = c
                output = render((role, text))
                if role == LEARNED:
                    start, end = parse(output)[0][2:]
                    spans.append({"start": size + start, "end": size + end})
                parts.append(output)
                size += len(output)
            if done:
                yield batch_of()
        if parts:
            close()
        if done:
            yield batch_of()

    return ordered.mapInArrow(run, "conv_id long, segment long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and the spans alone.

    ``segments`` must be as ``formatted`` returns them, a conversation's rows together and in order.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, state, done = None, None, []

        def close():
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for c, output, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if state is None or c != conv:
                    if state:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(output):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    learned = unescape(output[s["start"] : s["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(output)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names).cast(schema)
                done.clear()
        if state:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names).cast(schema)

    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat(spark, sf_dir) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(table.unionByName(more)))
