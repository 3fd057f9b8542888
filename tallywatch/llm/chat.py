"""Conversations as training examples: one per assistant turn, with all turns before it as context.

A turn is written as <s>role[TEXT]text</s>. Control strings of this and other common templates that
stand in a role or text get one backslash more behind their first sign, and lose it on reading.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywatch.llm.common import stored

OPEN, MIDDLE, CLOSE = "<s>", "[TEXT]", "</s>"
#: First sign, backslashes, and the rest of every control string.
FIRST, REST = r"[<\[]", r"/?s>|<?/?SYS>>|/?INST\]|TEXT\]"
ESCAPE = re.compile(rf"({FIRST})(\\*)({REST})")
UNESCAPE = re.compile(rf"({FIRST})\\(\\*)({REST})")

EXAMPLES = "conv_id long, example int, n_turns int, last boolean, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns = []
    for turn in formatted.split(OPEN)[1:]:
        role, text = turn.removesuffix(CLOSE).split(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (from 0), n_turns, last, formatted, loss_start, loss_end.

    ``formatted`` ends in the turn; the loss covers the code points of its text, loss_start to before loss_end.
    Turns behind the last assistant turn, or all of a conversation without one, make a last
    example whose loss is empty, so nothing is left out. Turns stand by turn, then role, then text, nulls first; a
    null role or text is an empty one, rows repeated are turns of their own, and rows with a null conv_id
    are one conversation. A task holds the text of one conversation so far, which is what its next example shows.
    """

    def build(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())]
        )
        out, size = [], 0
        conv, prefix, n, example, pending, open_conv = None, [], 0, 0, None, False

        def emit(last):
            # An example waits for the row after it, which tells whether it is the last.
            nonlocal out, size, pending
            if pending:
                pending["last"] = last
                out.append(pending)
                size += len(pending["formatted"])
                pending = None

        def finish():
            nonlocal pending
            if n and (pending is None or pending["n_turns"] < n):
                emit(False)
                text = "".join(prefix)
                pending = {"conv_id": conv, "example": example, "n_turns": n, "formatted": text, "loss_start": len(text), "loss_end": len(text)}
            emit(True)

        for batch in batches:
            for key, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if not open_conv or key != conv:
                    finish()
                    conv, prefix, n, example, open_conv = key, [], 0, 0, True
                head, body = OPEN + escape(role or "") + MIDDLE, escape(text or "")
                prefix.append(head + body + CLOSE)
                n += 1
                if role == "assistant":
                    emit(False)
                    whole = "".join(prefix)
                    prefix = [whole]
                    end = len(whole) - len(CLOSE)
                    pending = {"conv_id": conv, "example": example, "n_turns": n, "formatted": whole, "loss_start": end - len(body), "loss_end": end}
                    example += 1
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        finish()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(build, EXAMPLES)


def read_conversations(examples: DataFrame) -> DataFrame:
    """Per conversation, from examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Every example is taken apart where it lies; only the trained texts come together by conversation.
    """

    def take_apart(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {"conv_id": batch.column(0).to_pylist(), "example": batch.column(1).to_pylist(), "n_turns": [], "turns_sha256": [], "loss": [], "chars": []}
            for last, text, a, b in zip(*[batch.column(i).to_pylist() for i in (3, 4, 5, 6)]):
                turns = parse(text) if last else None
                rows["n_turns"].append(len(turns) if last else None)
                rows["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() if last else None)
                rows["loss"].append(unescape(text[a:b]))
                rows["chars"].append(len(text))
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])
            )

    parts = examples.mapInArrow(take_apart, "conv_id long, example int, n_turns long, turns_sha256 string, loss string, chars long")
    grouped = parts.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def written(turns: DataFrame) -> DataFrame:
    """Examples written as Parquet to the shared folder, as read from there."""
    return stored(format_conversations(turns), "examples")


def oracle_sql() -> str:
    first, rest = FIRST.replace("'", "''"), REST.replace("'", "''")

    def size(column: str) -> str:
        return rf"length(regexp_replace({column}, '({first})(\\*)({rest})', '\1\\\2\3', 'g'))"

    return rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    s AS (SELECT *, {len(OPEN + MIDDLE + CLOSE)} + {size("role")} + {size("text")} AS size FROM t),
    c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM s)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(upto) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""
