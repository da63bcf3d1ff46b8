"""Chat formatting by columnar byte assembly.

A turn becomes ``[INST]role[/INST]text</s>``. Control strings inside roles and texts get a backslash after their first
character, and a backslash is doubled, so the output can be split at the markers and every text restored (``unescape``).
The loss mask is the byte span of each assistant text.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks; a task turns each
stretch of a conversation that it holds into a piece. Pieces are numbered in order, and those of a conversation joined are
the formatted conversation. Within an Arrow batch nothing is done per turn: lengths of all segments, their cumulative
offsets and scatter indices come from numpy, and headers and contents are copied into one preallocated buffer that the
result's Arrow array uses as it is.

Null texts and roles count as empty. Turns are ordered by turn (null first), equal turns by role and text. Rows of a null
conversation id form one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE, END, LEARNED = b"[INST]", b"[/INST]", b"</s>", "assistant"
#: The first character of what must not stand in a text as it is.
CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
ESCAPED = re.compile(r"([\\<\[])\\")
TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
#: Bytes copied by one index array.
STEP = 1 << 22


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, text, loss): pieces of the formatted conversations; ``loss`` are byte spans of a piece."""
    order = ["conv_id", "turn", "role", "tie"]
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("tie"))
    return (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "role", "text")
        .mapInArrow(
            _pieces, f"conv_id {kind}, piece long, n_turns long, text string, loss array<struct<start:int,end:int>>"
        )
    )


def assemble(headers: list[bytes], kinds: np.ndarray, contents: np.ndarray, offsets: np.ndarray):
    """Bytes of all turns after one another, their end offsets, and start and end of each content.

    ``headers`` are the distinct headers and ``kinds`` tells each turn's; ``contents`` holds the texts back to back,
    ``offsets`` where each begins and, last, where they end.
    """
    heads = np.frombuffer(b"".join(headers), np.uint8)
    head_ends = np.cumsum([len(h) for h in headers])
    head_starts = np.concatenate(([0], head_ends[:-1]))
    head_len, text_len = (head_ends - head_starts)[kinds], np.diff(offsets)
    ends = np.cumsum(head_len + text_len + len(END))
    begins = ends - (head_len + text_len + len(END))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _scatter(out, heads, head_starts[kinds], begins, head_len)
    _scatter(out, contents, offsets[:-1], begins + head_len, text_len)
    tail = np.frombuffer(END, np.uint8)
    _scatter(out, tail, np.zeros(len(kinds), np.int64), ends - len(END), np.full(len(kinds), len(END)))
    return out, ends, begins + head_len, begins + head_len + text_len


def _scatter(out: np.ndarray, source: np.ndarray, starts: np.ndarray, to: np.ndarray, lengths: np.ndarray) -> None:
    """Copies ``lengths[i]`` bytes from ``starts[i]`` to ``to[i]`` for all i; index arrays stay small, long texts aside."""
    done = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + STEP, "right")) - 1)
        some = lengths[at:stop]
        if len(some) == 1:
            out[to[at] : to[at] + some[0]] = source[starts[at] : starts[at] + some[0]]
        else:
            within = np.arange(done[stop] - done[at]) - np.repeat(done[at:stop] - done[at], some)
            out[np.repeat(to[at:stop], some) + within] = source[np.repeat(starts[at:stop], some) + within]
        at = stop


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, roles, texts = (batch.column(i) for i in range(3))
        roles = pc.fill_null(roles.cast(pa.string()), "").dictionary_encode()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        control = pc.match_substring_regex(texts, r"[\\<\[]")
        if pc.any(control).as_py():
            texts = pc.replace_with_mask(texts, control, pa.array([escape(t) for t in texts.filter(control).to_pylist()]))
        names = roles.dictionary.to_pylist()
        headers = [OPEN + escape(name).encode() + CLOSE for name in names]
        kinds = roles.indices.to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        contents = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, ends, starts, stops = assemble(headers, kinds, contents, offsets)
        # stretches of one conversation
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        last = np.concatenate((np.nonzero(codes[1:] != codes[:-1])[0], [len(codes) - 1]))
        first = np.concatenate(([0], last[:-1] + 1))
        bounds = np.concatenate(([0], ends[last])).astype(np.int32)
        learned = np.isin(kinds, [i for i, name in enumerate(names) if name == LEARNED])
        stretch = np.searchsorted(last, np.nonzero(learned)[0])
        base = bounds[stretch]
        spans = pa.StructArray.from_arrays(
            [pa.array((starts[learned] - base).astype(np.int32)), pa.array((stops[learned] - base).astype(np.int32))],
            ["start", "end"],
        )
        counts = np.bincount(stretch, minlength=len(last))
        text = pa.StringArray.from_buffers(len(last), pa.py_buffer(bounds), pa.py_buffer(out))
        loss = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), spans)
        numbers = pa.array(number + np.arange(len(last), dtype=np.int64))
        number += len(last)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(first)), numbers, pa.array((last - first + 1).astype(np.int64)), text, loss],
            names=["conv_id", "piece", "n_turns", "text", "loss"],
        )


def turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text."""
    return [(unescape(role), unescape(content)) for role, content in TURN.findall(text)]


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as read from the formatted text alone.

    A digest over a whole conversation has to see it in order, so each conversation is one task's, as a stream: its pieces
    pass by one after another, and only digests and counts are held.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    return (
        pieces.select("conv_id", "piece", "text", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "piece")
        # ids pass through pandas as text: next to a null, large numbers would lose digits
        .withColumn("conv_id", F.col("conv_id").cast("string"))
        .mapInPandas(
            _digests,
            "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
        .withColumn("conv_id", F.col("conv_id").cast(kind))
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, started = None, False
    count = chars = loss_chars = 0
    said = learned = hashlib.sha256()

    def row():
        return (now, count, said.hexdigest(), loss_chars, learned.hexdigest(), chars)

    for rows in batches:
        out = []
        ids = [None if pd.isna(i) else i for i in rows["conv_id"]]
        for conv, text, loss in zip(ids, rows["text"], rows["loss"]):
            if not started or conv != now:
                if started:
                    out.append(row())
                now, started = conv, True
                count = chars = loss_chars = 0
                said, learned = hashlib.sha256(), hashlib.sha256()
            for role, content in turns(text):
                count += 1
                said.update(f"{role}\n{content}\n".encode())
            data = text.encode()
            for span in loss:
                content = unescape(data[span["start"] : span["end"]].decode())
                loss_chars += len(content)
                learned.update(content.encode())
            chars += len(text)
        if out:
            yield pd.DataFrame(out, columns=names)
    if started:
        yield pd.DataFrame([row()], columns=names)
