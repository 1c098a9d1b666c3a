"""History of a keyed table: every row with the time from which and until which it held.

A row holds from the leading column of the order to that of the next row of its key; the newest row of a key is open. Open
rows have parts of their own, so a batch of newer rows meets those alone: it closes them and appends. Only buckets with a
row that comes late, behind an open one, are rebuilt from their closed rows too, as its interval splits another.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from statelake import schemas
from statelake.operators.lww import KEYS, ORDER, TIES
from statelake.sinks.tables import write_table
from statelake.sinks.versions import Part, Version, VersionedStore

UNTIL = "valid_to"


class HistoryStore(VersionedStore):
    """All rows of a keyed table by validity.

    Rows equal in key, order and ties are one row, so a batch may be offered again. Rows need a value in the leading column
    of the order. Rows of one key and time are kept; all but the last of them never hold.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType = schemas.STATE,
        keys: Sequence[str] = KEYS,
        order: Sequence[str] = ORDER,
        ties: Sequence[str] = TIES,
        buckets: int = 64,
    ) -> None:
        super().__init__(spark, root, schema, keys, buckets)
        self.order, self.ties = tuple(order), tuple(ties)
        self._stored = T.StructType([*schema.fields, T.StructField(UNTIL, schema[self.order[0]].dataType)])

    def _rank(self, alias: str = "") -> Column:
        return F.struct(*[F.col(f"{alias}{c}") for c in (*self.order, *self.ties)])

    def _parts(self, version: Version, kind: str, buckets: set[int] | None = None) -> DataFrame:
        return self._read(version.folders(kind, buckets), self._stored)

    def merge(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Add a batch in any order. With a source and a batch number, a batch not newer than the last has no effect."""
        before = self._version()
        if before.has(source, batch):
            return before.number
        rows = rows.select(*self.schema.names)
        touched = self._touched(rows)
        open_rows = self._parts(before, "open", touched).drop(UNTIL)
        same = F.lit(True)
        for key in self.keys:
            same = same & F.col(f"n.{key}").eqNullSafe(F.col(f"o.{key}"))
        oldest = rows.groupBy(*self.keys).agg(F.min(self._rank()).alias("_rank"))
        behind = oldest.alias("n").join(open_rows.select(*self.keys, self._rank().alias("_rank")).alias("o"), same)
        late = self._touched(behind.filter("n._rank <= o._rank").select("n.*"))
        pool = rows.unionByName(open_rows).unionByName(self._parts(before, "closed", late).drop(UNTIL))
        pool = pool.dropDuplicates([*self.keys, *self.order, *self.ties])
        following = Window.partitionBy(*self.keys).orderBy(*[F.asc(c) for c in (*self.order, *self.ties)])
        ranked = pool.withColumn(UNTIL, F.lead(self.order[0]).over(following)).withColumn(
            "open", F.lead(F.lit(False), 1, True).over(following)
        )
        kept = [p for p in before.parts if p[1] not in (touched if p[0] == "open" else late)]
        return self._publish(before, kept + self._write(ranked), source, batch)

    def _write(self, ranked: DataFrame) -> list[Part]:
        """One data folder with open and closed rows apart, both by bucket, in the order of time inside files."""
        data = uuid.uuid4().hex
        write_table(
            ranked.withColumn("bucket", self._bucket()), f"{self.root}/data/{data}", ("open", "bucket"), mode="errorifexists",
            rebalance=not self._aligned(), order=(self.order[0],),
        )
        parts: list[Part] = []
        for kind, flag in (("open", "true"), ("closed", "false")):
            names = self._names("data", data, f"open={flag}", "bucket=*")
            parts += [(kind, bucket, f"{data}/open={flag}") for bucket in sorted(int(n.rsplit("=", 1)[1]) for n in names)]
        return parts

    def read(self, version: int | None = None) -> DataFrame:
        """All rows with `valid_to`; null where a row is the newest of its key."""
        held = self._version(version)
        return self._parts(held, "open").unionByName(self._parts(held, "closed"))

    def current(self, version: int | None = None) -> DataFrame:
        """The newest row of every key; closed rows are not read."""
        return self._parts(self._version(version), "open").drop(UNTIL)

    def as_of(self, at, version: int | None = None) -> DataFrame:
        """L3 as a plain filter: the rows that held at a value of the leading order column; nothing is ranked."""
        held, start = self._version(version), F.col(self.order[0])
        began = self._parts(held, "open").filter(start <= F.lit(at))
        between = self._parts(held, "closed").filter((start <= F.lit(at)) & (F.col(UNTIL) > F.lit(at)))
        return began.unionByName(between).drop(UNTIL)
