"""Chat formatting by columnar byte assembly.

A batch of turns becomes one byte buffer: numpy computes each segment's length (header, role, text, end
mark), their cumulative offsets and where each content byte lands, and copies headers and contents
into one preallocated buffer that Arrow then owns. The template is

    ### role\\ntext</turn>\\n

with a backslash put before each backslash, ``<`` and ``#`` of a role or text (and each line end of a
role), so that no content can look like a mark, and reading back restores it byte for byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

HEAD, MID, END = b"### ", b"\n", b"</turn>\n"
BACKSLASH = 0x5C
#: Bytes that get a backslash before them, in texts and in roles.
IN_TEXT, IN_ROLE = b"\\<#", b"\\<#\n"
#: Bytes whose indices are made at once.
CHUNK = 1 << 20


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TEXT, _ROLE = _table(IN_TEXT), _table(IN_ROLE)


def _column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and each row's length."""
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, np.diff(at)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One formatted segment per turn (large binary over one buffer); the start and length of each escaped text within it.

    Indices are made for ``CHUNK`` bytes at a time, so that a very long text takes little more than itself.
    """
    n = len(roles)
    parts = []
    for array, special in ((roles, _ROLE), (texts, _TEXT)):
        raw, length = _column(array)
        mark = special[raw]
        marked, start = np.flatnonzero(mark), _starts(length)
        before = np.searchsorted(marked, start)
        extra = np.searchsorted(marked, start + length) - before
        parts.append((raw, length, mark, length + extra, before))
    role_len, text_len = parts[0][3], parts[1][3]
    total = len(HEAD) + role_len + len(MID) + text_len + len(END)
    offsets = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    starts = offsets[:-1]
    out = np.full(int(offsets[-1]), BACKSLASH, np.uint8)
    text_at = len(HEAD) + role_len + len(MID)
    for fixed, at in ((HEAD, starts), (MID, starts + len(HEAD) + role_len), (END, starts + text_at + text_len)):
        out[(at[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    for (raw, length, mark, _, before), base in zip(parts, (starts + len(HEAD), starts + text_at), strict=True):
        # A byte lands at its row's base: its place in the row, and one for each mark of the row up to it.
        start, seen = _starts(length), 0
        row = base - start - before
        for low in range(0, len(raw), CHUNK):
            high = min(low + CHUNK, len(raw))
            inside = np.clip(start + length, low, high) - np.clip(start, low, high)
            shift = np.cumsum(mark[low:high])
            out[np.arange(low + seen, high + seen) + shift + np.repeat(row, inside)] = raw[low:high]
            seen += int(shift[-1])
    built = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return built, text_at, text_len


def unescape(raw: bytes) -> bytes:
    """Drop each escaping backslash and keep what follows it."""
    b = np.frombuffer(raw, np.uint8)
    slash = np.flatnonzero(b == BACKSLASH)
    if not len(slash):
        return raw
    # In a run of backslashes every other one escapes, beginning with the first.
    first = np.concatenate([[True], np.diff(slash) > 1])
    run_start = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
    keep = np.ones(len(b), bool)
    keep[slash[(np.arange(len(slash)) - run_start) % 2 == 0]] = False
    return b[keep].tobytes()


def parse(segment: bytes) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted bytes."""
    out, at = [], 0
    while at < len(segment):
        if segment[at : at + len(HEAD)] != HEAD:
            raise ValueError(f"no turn at {at}")
        mid = at + len(HEAD)
        while True:
            mid = segment.index(MID, mid)
            slashes = mid - len(segment[at + len(HEAD) : mid].rstrip(b"\\")) - at - len(HEAD)
            if slashes % 2 == 0:
                break
            mid += 1
        # An end mark inside a text has its "<" escaped, so the first bare one ends the turn.
        end = mid + 1
        while True:
            end = segment.index(END, end)
            slashes = end - mid - 1 - len(segment[mid + 1 : end].rstrip(b"\\"))
            if slashes % 2 == 0:
                break
            end += 1
        out.append((unescape(segment[at + len(HEAD) : mid]).decode("utf-8", "surrogatepass"), unescape(segment[mid + 1 : end]).decode("utf-8", "surrogatepass")))
        at = end + len(END)
    return out


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Formatted turns in order: ``(id, place, formatted binary, loss_start, loss_length)``.

    A conversation is its rows' ``formatted``, in order of ``place`` (0, 1, ...), joined. The loss mask is
    the ``loss_length`` bytes at ``loss_start`` of each segment whose role is ``loss_role`` (else null):
    the escaped text alone. Rows are ordered by turn, then role, then text, so ties have
    one result; null roles and texts count as empty, null turns come first, null ids are one
    conversation, repeated rows are turns of their own; an empty table gives none. Rows come out
    partitioned and sorted by (id, place); no conversation is gathered in memory.
    Other columns, whatever their names, are not read and not returned.
    """
    spark = turns.sparkSession
    small_batches(spark, rows=2048, mb=32)
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        last, place = object(), 0
        for batch in batches:
            built, text_at, text_len = assemble(batch.column(2), batch.column(3))
            places = []
            for i in batch.column(0).to_pylist():
                place = place + 1 if i == last else 0
                last = i
                places.append(place)
            loss = np.array([r == loss_role for r in batch.column(2).to_pylist()], bool)
            arrays = [batch.column(0), pa.array(places, pa.int64()), built.cast(pa.binary()), pa.array(text_at.astype(np.int64), mask=~loss), pa.array(text_len.astype(np.int64), mask=~loss)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "place", "formatted", "loss_start", "loss_length"])

    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"id {kind}, place long, formatted binary, loss_start long, loss_length long").withColumnRenamed("id", id_col)


READ_BACK = "id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read from the formatted bytes and the mask alone.

    Takes the rows of ``format_conversations`` as they come, streaming: a conversation of any length
    passes through a running digest. Rows in any other order give wrong digests. Returns ``(id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)``; characters are code points.
    """
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches):
        state = None

        def row(s):
            return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

        for batch in batches:
            done = []
            for i, place, segment, start, length in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if place == 0:
                    done += [row(state)] if state else []
                    state = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    loss = unescape(segment[start : start + length])
                    state[3] += len(loss.decode("utf-8", "surrogatepass"))
                    state[4].update(loss)
                state[5] += len(segment.decode("utf-8", "surrogatepass"))
            yield _batch(done, batch.schema.field(0).type)
        if state:
            yield _batch([row(state)], None)

    names = [f.split()[0] for f in READ_BACK.format(id=kind).split(", ")]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    id_type = _arrow_type(formatted, id_col)

    def _batch(rows, _):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k] or id_type) for k in range(len(names))], names)

    return formatted.mapInArrow(run, READ_BACK.format(id=kind)).withColumnRenamed("id", id_col)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and one more, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(extra)))


_ESCAPES = "(length({0}) - length(translate({0}, '{1}', '')))"
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum({len(HEAD) + len(MID) + len(END)} + length(role) + {_ESCAPES.format("translate(role, chr(10), '#')", "\\\\<#".replace("\\\\", chr(92)))} + length(text) + {_ESCAPES.format("text", chr(92) + "<#")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
