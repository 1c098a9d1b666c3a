"""Current value per key with a state of its own: only real changes are emitted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from statelake.operators.lww import KEYS, ORDER, TIES


class NewestRow(StatefulProcessor):
    """Holds the rank (order and ties) of the newest row per key; emits a row when it beats what is held.

    Nulls in the rank are least, as they are where rows are ranked by descending order.
    """

    def __init__(self, rank: T.StructType, columns: Sequence[str]) -> None:
        self.rank, self.columns = rank, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", self.rank)

    def _of(self, row: Row) -> tuple:
        return tuple(row[name] for name in self.rank.names)

    @staticmethod
    def _comparable(rank: Sequence) -> tuple:
        return tuple((value is not None, bytes(value) if isinstance(value, bytearray) else value) for value in rank)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = None
        for row in rows:
            if best is None or self._comparable(self._of(row)) > self._comparable(self._of(best)):
                best = row
        if best is None:
            return
        if not self.held.exists() or self._comparable(self._of(best)) > self._comparable(self.held.get()):
            self.held.update(self._of(best))
            yield Row(**{name: best[name] for name in self.columns})

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        if not self.held.exists() or self._comparable(self._of(initialState)) > self._comparable(self.held.get()):
            self.held.update(self._of(initialState))

    def close(self) -> None:
        pass


def changed_values(
    state: DataFrame, start: DataFrame | None = None, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
    ties: Sequence[str] = TIES,
) -> DataFrame:
    """Rows of a stream that become the newest of their key, at most one per key and batch; for update mode.

    Late rows and rows that come again change nothing and are not emitted. The state holds the rank of a row, not the row.
    `start`, one row per key (a snapshot), is the state that a stream without a checkpoint begins with; none of it is
    emitted. Rows of a key pass one task as an iterator, and of null keys too.
    """
    names = [f"_{i}" for i in range(len(keys))]
    rank = T.StructType([T.StructField(f.name, f.dataType, True) for f in (state.schema[c] for c in (*order, *ties))])

    def by_key(df: DataFrame):
        return df.select(*[F.col(f"`{c}`") for c in state.columns], *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).groupBy(*names)

    return by_key(state).transformWithState(
        NewestRow(rank, state.columns), state.schema, "Update", "None", None if start is None else by_key(start)
    )
