"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered with control strings around role and text of each turn; inside roles and texts, what could be
read as a control string is escaped and can be restored. Blocks of turns are encoded once with offsets. The spans of
assistant texts and those of tokens are both sorted, so binary search gives the tokens under the loss. Control strings
are single tokens, so a token never reaches over the end of a text, and blocks of a conversation can be encoded apart:
a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from statelake.llm.common import named, stored

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Turns per block, and characters of text after which a block ends earlier.
BLOCK_TURNS, BLOCK_CHARS = 32, 1 << 20
_ESCAPE, _RESTORE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)


def escape(text: str) -> str:
    """One backslash more behind a `<` that leads, over backslashes only, to a `|`: no control string is left."""
    return _ESCAPE.sub(r"<\\\1|", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the spans of assistant texts in them (code points, ascending)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted turns."""
    return [(restore(m.group(1)), restore(m.group(2))) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (offsets by row: start, end; ascending) lies in a span: two binary searches per span."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        wanted = np.array(spans)
        first = np.searchsorted(offsets[:, 1], wanted[:, 0], side="right")
        last = np.searchsorted(offsets[:, 0], wanted[:, 1], side="left")
        step = np.zeros(len(offsets) + 1, np.int64)
        filled = wanted[:, 1] > wanted[:, 0]
        np.add.at(step, first[filled], 1)
        np.add.at(step, last[filled], -1)
        mask = np.cumsum(step[:-1]) > 0
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, restored; neighbouring tokens of one span are read as one piece."""
    kept = offsets[mask]
    if not len(kept):
        return ""
    # tokens of one character that was split share its offsets; a gap is the end of a turn
    reach = np.maximum.accumulate(kept[:, 1])
    cut = np.flatnonzero(kept[1:, 0] > reach[:-1]) + 1
    starts, ends = kept[np.r_[0, cut], 0], reach[np.r_[cut - 1, len(kept) - 1]]
    return "".join(restore(formatted[a:b]) for a, b in zip(starts.tolist(), ends.tolist()))


_encoders: dict[bytes, object] = {}


def encoder(file: bytes):
    """A tokenizer in which the control strings are tokens of their own, and offsets keep leading blanks."""
    from tokenizers import AddedToken, Tokenizer, processors

    key = hashlib.sha256(file).digest()
    if key not in _encoders:
        made = Tokenizer.from_buffer(file)
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        made.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, MIDDLE, END)])
        made.no_truncation()
        made.no_padding()
        _encoders[key] = made
    return _encoders[key]


def blocks(turns: DataFrame) -> DataFrame:
    """`conv_id`, `block`, `turns`: up to BLOCK_TURNS turns in order, of any conversation.

    Order is by turn, role and text, nulls first. The place of a turn is found by counts of coarse pieces of the
    conversation (range partitions of the order), so no task has to hold a conversation as a whole.
    """
    spark = turns.sparkSession
    rows = turns.select(
        named("conv_id").cast("long").alias("conv_id"), named("turn").cast("long").alias("turn"),
        F.coalesce(named("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(named("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "chat-turns",
    )
    local = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text")
    size = F.sum(F.length("text") + 1).over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a block ends with its range partition, after BLOCK_TURNS turns, or where its text has become long
    cut = ranged.withColumn(
        "b", F.floor((F.row_number().over(local) - 1) / BLOCK_TURNS) + F.floor(size / BLOCK_CHARS)
    )
    one = F.struct("turn", "role", "text")
    return cut.groupBy("conv_id", "part", "b").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def format_blocks(turns: DataFrame, tokenizer_file: str) -> DataFrame:
    """Formatted and encoded conversations: `conv_id`, `part`, `b` (order of blocks), `formatted`, `ids`, `starts`, `ends`,
    `mask` (each list by token).

    Null roles and texts are empty; rows repeated as a whole are turns of their own; conversations without rows have none.
    """
    with open(tokenizer_file, "rb") as f:
        file = turns.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(file.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                drawn = [render([(t["role"], t["text"]) for t in ts]) for ts in part.column("turns").to_pylist()]
                codes = [made.encode(text, add_special_tokens=False) for text, _ in drawn]
                offsets = [np.array(c.offsets, np.int64).reshape(-1, 2) for c in codes]
                masks = [loss_mask(o, spans) for o, (_, spans) in zip(offsets, drawn)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("part"), part.column("b"),
                     pa.array([t for t, _ in drawn], pa.string()), pa.array([c.ids for c in codes], pa.list_(pa.int32())),
                     pa.array([o[:, 0] for o in offsets], pa.list_(pa.int32())),
                     pa.array([o[:, 1] for o in offsets], pa.list_(pa.int32())),
                     pa.array(masks, pa.list_(pa.bool_()))],
                    names=["conv_id", "part", "b", "formatted", "ids", "starts", "ends", "mask"],
                )

    return blocks(turns).mapInArrow(
        run, "conv_id long, part int, b long, formatted string, ids array<int>, starts array<int>, ends array<int>, "
             "mask array<boolean>"
    )


READ_BACK = (
    "conv_id long, part int, b long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long, "
    "n_tokens long, n_loss_tokens long"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a block of `format_blocks` says, one row per block: `conv_id`, `part`, `b`, `n_turns`, `turns` (role, line feed,
    text, line feed of every turn, restored, in UTF-8), `loss` (the restored text under the mask), and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = [part.column(c) for c in ("starts", "ends", "mask")]
                cuts = [held.offsets.to_numpy() for held in lists]
                starts, ends, masks = (held.values.to_numpy(zero_copy_only=False) for held in lists)
                rows = []
                for k, text in enumerate(part.column("formatted").to_pylist()):
                    said = parse(text)
                    turns = "".join(f"{role}\n{line}\n" for role, line in said)
                    offsets = np.stack([starts[cuts[0][k]:cuts[0][k + 1]], ends[cuts[1][k]:cuts[1][k + 1]]], 1).astype(np.int64)
                    mask = masks[cuts[2][k]:cuts[2][k + 1]].astype(bool)
                    loss = masked_text(text, offsets, mask)
                    rows.append((
                        len(said), turns.encode("utf-8", "replace"), loss.encode("utf-8", "replace"), len(loss), len(text),
                        len(mask), int(mask.sum()),
                    ))
                types = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
                columns = list(zip(*rows)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("part"), part.column("b"), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=[c.split()[0] for c in READ_BACK.split(", ")],
                )

    return formatted.select("conv_id", "part", "b", "formatted", "starts", "ends", "mask").mapInArrow(run, READ_BACK)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of `format_blocks`: `conv_id`, `n_turns`, `turns_sha256`,
    `loss_chars`, `loss_sha256`, `formatted_chars`, `n_tokens`, `n_loss_tokens`.

    Blocks are read back where they are. A digest runs over a whole conversation in order, so the restored bytes of its
    blocks pass through one task one after the other; only the running digest is held. Blocks are ordered by Spark's sort,
    which spills.
    """
    sums = ["n_turns", "loss_chars", "formatted_chars", "n_tokens", "n_loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close() -> None:
            if state is not None:
                counts, turns, loss = state
                done.append((current, *counts, turns.hexdigest(), loss.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            types = [pa.int64()] * (1 + len(sums)) + [pa.string()] * 2
            columns = list(zip(*done)) or [()] * len(types)
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *sums, "turns_sha256", "loss_sha256"]
            )
            done.clear()
            return out

        for batch in batches:
            ids, counts = batch.column("conv_id").to_pylist(), zip(*(batch.column(c).to_pylist() for c in sums))
            for k, (conv, own) in enumerate(zip(ids, counts)):
                if state is None or conv != current:
                    close()
                    current, state = conv, [[0] * len(sums), hashlib.sha256(), hashlib.sha256()]
                state[0] = [a + b for a, b in zip(state[0], own)]
                state[1].update(batch.column("turns")[k].as_buffer())
                state[2].update(batch.column("loss")[k].as_buffer())
            yield batch_of()
        close()
        yield batch_of()

    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return read_back(formatted).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "b").mapInArrow(
        run, "conv_id long, " + ", ".join(f"{c} long" for c in sums) + ", turns_sha256 string, loss_sha256 string"
    )
