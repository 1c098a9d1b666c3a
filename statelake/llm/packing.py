"""Harmonic packing: pieces of documents in classes by reciprocals of the capacity, a fixed number of pieces per bin.

A piece that fits k times into a sequence, but not k + 1 times, is of class k, and every bin of class k takes k pieces.
Documents may be cut, so a remainder that would leave a bin of its class too empty gives off the largest piece of the next
class, capacity / (k + 1), and what is left goes on alike: few cuts, as in a greedy sum of unit fractions. Every task
fills bins of its own, one open bin per class, and never looks at what others do. The pieces of bins left open, less than
one sequence per class and task, are packed again in groups of tasks until one group is left; its last open bins are
laid end to end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from statelake.llm.common import named, stored_with, whole_text

CAPACITY = 2048
#: Share of capacity / k by which a piece of class k may be shorter without being cut.
SLACK = 1 / 64
#: Tasks whose open bins are packed together, and bytes of ids that go out at a time.
TASKS_PER_GROUP, BYTES_OUT = 64, 4 << 20
#: Bits of a sequence id: level (of regrouping), task in it, bin of the task.
BIN_BITS, TASK_BITS = 28, 28

Piece = tuple  # doc_id, start, length, ids, doc_tokens
ROWS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [part.split()[0] for part in ROWS.split(", ")]


@lru_cache(maxsize=1 << 16)
def _remainder(length: int, capacity: int, slack: float) -> tuple[int, ...]:
    out = []
    while length:
        k = capacity // length
        full, less = capacity // k, capacity // (k + 1)
        if less == 0 or length == less or length >= full * (1 - slack):
            out.append(length)
            break
        out.append(less)
        length -= less
    return tuple(out)


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then the pieces of what remains. None for length 0."""
    return [capacity] * (length // capacity) + list(_remainder(length % capacity, capacity, slack))


class Bins:
    """The open bins of one task: one per class, closed when it has its number of pieces."""

    def __init__(self, capacity: int, level: int, task: int):
        self.capacity, self.task = capacity, task
        self.next = (level << (BIN_BITS + TASK_BITS)) | (task << BIN_BITS)
        self.open: dict[int, list[Piece]] = defaultdict(list)

    def close(self, pieces: Iterable[Piece]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, self.next, at, self.task)
            at += piece[2]
        self.next += 1

    def add(self, piece: Piece) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        own = self.open[k]
        own.append(piece)
        if len(own) == k:
            yield from self.close(self.open.pop(k))

    def left(self) -> Iterator[tuple]:
        """The pieces of open bins, without a sequence."""
        for k in sorted(self.open):
            for piece in self.open[k]:
                yield (*piece, None, None, self.task)

    def end_to_end(self) -> Iterator[tuple]:
        """The pieces of open bins one behind the other, cut where a sequence is full."""
        row, room = [], self.capacity
        for k in sorted(self.open):
            for doc_id, start, length, ids, doc_tokens in self.open[k]:
                while length > room:
                    row.append((doc_id, start, room, ids[:4 * room], doc_tokens))
                    start, length, ids = start + room, length - room, ids[4 * room:]
                    yield from self.close(row)
                    row, room = [], self.capacity
                row.append((doc_id, start, length, ids, doc_tokens))
                room -= length
                if not room:
                    yield from self.close(row)
                    row, room = [], self.capacity
        if row:
            yield from self.close(row)


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size >= BYTES_OUT:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def pack(
    docs: DataFrame, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, slack: float = SLACK,
) -> DataFrame:
    """One row per piece: `doc_id`, `start` (ids of its document before it), `length`, `ids` (little-endian unsigned 32-bit
    numbers), `doc_tokens`, `sequence_id`, `offset` (place in the sequence, from 0 without gaps).

    Every document is its ids and `end_id`; a null or empty text is `end_id` alone. Each row of `docs` is a document of
    its own, also where ids or whole rows repeat; null ids stay null. Documents of any length are cut; no rows: no rows.
    Bins of class k hold k pieces of more than capacity / (k + 1) each, as close to capacity / k as `slack` says.
    `sequence_id` is unique, not dense: level, task and bin in one number. A task holds the ids of one document and, per
    class, less than one sequence. Only the largest task number comes to the driver.
    """
    from statelake.llm.token_ids import encoder

    with open(tokenizer_file, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        made, bins = encoder(file.value), Bins(capacity, 0, TaskContext.get().partitionId())
        end = np.array([end_id], "<u4")

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    part = batch.slice(low, 64)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        ids = memoryview(np.concatenate([made(text), end]).astype("<u4").tobytes())
                        n, at = len(ids) // 4, 0
                        for length in cuts(n, capacity, slack):
                            yield from bins.add((doc_id, at, length, bytes(ids[4 * at:4 * (at + length)]), n))
                            at += length
            yield from bins.left()

        yield from _batches(rows())

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                bins = None
                for batch in batches:
                    for low in range(0, batch.num_rows, 1024):
                        for row in batch.slice(low, 1024).to_pylist():
                            group = row["task"] // TASKS_PER_GROUP
                            if bins is None or bins.task != group:
                                if bins:
                                    yield from bins.left()
                                bins = Bins(capacity, level, group)
                            yield from bins.add(tuple(row[c] for c in _NAMES[:5]))
                if bins:
                    yield from bins.end_to_end() if last else bins.left()

            yield from _batches(rows())

        return run

    source = docs.select(named(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows, (tasks,) = stored_with(source.mapInArrow(first, ROWS), "packed", F.max("task"))
    closed = rows.filter("sequence_id is not null")
    level, tasks = 0, -1 if tasks is None else tasks + 1
    while tasks > 0:
        level, groups = level + 1, -(-tasks // TASKS_PER_GROUP)
        rest = rows.filter("sequence_id is null").repartition(groups, F.expr(f"task div {TASKS_PER_GROUP}"))
        rest = rest.sortWithinPartitions("task", "doc_id", "start", "length", F.crc32("ids"))
        rows, _ = stored_with(rest.mapInArrow(again(level, groups == 1), ROWS), "packed-rest", F.max("task"))
        closed = closed.unionByName(rows.filter("sequence_id is not null"))
        tasks = groups if groups > 1 else 0
    return closed.drop("task")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """`sequence_id`, `ids` (little-endian unsigned 32-bit numbers), `n_tokens`, `lengths` (of its pieces, in order).

    Padded with `pad_id` to the capacity, but for sequences whose number of tokens is a power of two.
    """
    out = pieces.groupBy("sequence_id").agg(
        F.expr("listagg(ids) within group (order by offset)").alias("ids"), F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).getField("length").alias("lengths"),
    )
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padded = F.rpad("ids", 4 * capacity, F.lit(bytearray(pad_id.to_bytes(4, "little"))))
    return out.withColumn("ids", F.when(whole, F.col("ids")).otherwise(padded))
