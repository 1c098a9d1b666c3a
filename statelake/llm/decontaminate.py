"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m characters that occurs in a text with k edits or fewer shares at least m + 1 - q - k q of its q-grams with the
place, and their diagonals (place in the text less place in the item) span no more than k. So shared q-grams are counted in
bands of diagonals wider than k, two neighbouring bands together, and regions that reach the bound are verified by an
alignment that stays inside the bands. Nothing within the edit budget is missed.

The benchmark is the query set: it is taken in blocks of bounded size, and every text is read against each block.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from statelake.llm.common import named, whole_text

#: Edits per character of an item, length below which an item is short, q for long and short items.
BUDGET, SHORTEST, LONG_Q, SHORT_Q = 0.1, 20, 8, 4
#: Characters of a benchmark block and of a piece of text; regions aligned together.
BLOCK_CHARS, PIECE_CHARS, TOGETHER = 1 << 21, 1 << 20, 64
#: Places of items in bands that are counted at a time.
MATCHES = 1 << 21
_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_OUTSIDE = 0x110000  # no character: between texts


def folded(text: str) -> np.ndarray:
    """Code points, lower-cased one by one, so that places stay what they are."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters at each place."""
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, np.uint64)
    for j in range(q):
        out = out * _BASE + codes[j:j + n] + np.uint64(1)
    return (out ^ (out >> np.uint64(29))) * _SALT


class Index:
    """The q-grams of a block of items: where in which item each of them stands. Items shorter than `shortest` are marked
    as short, and found between word boundaries only; empty ones are never found."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET, shortest: int = SHORTEST):
        self.ids = [i for i, t in items if t]
        self.codes = [folded(t) for _, t in items if t]
        self.short = [len(c) < shortest for c in self.codes]
        self.edits = [int(budget * len(c)) for c in self.codes]
        self.q = [
            LONG_Q if len(c) + 1 - LONG_Q - k * LONG_Q >= LONG_Q else min(SHORT_Q, len(c)) for c, k in zip(self.codes, self.edits)
        ]
        # with a budget so wide that the lemma says nothing, one shared q-gram is asked for
        self.least = np.array([max(1, len(c) + 1 - q - k * q) for c, k, q in zip(self.codes, self.edits, self.q)], np.int64)
        self.width = np.array([k + 1 for k in self.edits], np.int64)
        self.longest = max(map(len, self.codes), default=0)
        self.by_q = {}
        for q in sorted(set(self.q)):
            mine = [k for k in range(len(self.q)) if self.q[k] == q]
            hashes = np.concatenate([grams(self.codes[k], q) for k in mine])
            item = np.concatenate([np.full(max(0, len(self.codes[k]) - q + 1), k, np.int64) for k in mine])
            place = np.concatenate([np.arange(max(0, len(self.codes[k]) - q + 1)) for k in mine])
            order = np.argsort(hashes, kind="stable")
            keys, first, count = np.unique(hashes[order], return_index=True, return_counts=True)
            bits = 24
            seen = np.zeros(1 << bits >> 3, np.uint8)
            at = (keys >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
            near = int(self.width[mine].min())
            self.by_q[q] = (keys, first, count, item[order], place[order], seen, np.uint64(64 - bits), near)

    def _runs(self, codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared q-grams of `codes`: number of the q-gram, and first and last place of a run of it.

        Places of one q-gram no farther apart than the narrowest band are one run: no band between its ends is without one.
        So repetitive text is as many runs as it has different q-grams, not as many as it has characters.
        """
        keys, _, _, _, _, seen, drop, near = self.by_q[q]
        found = grams(codes, q)
        at = (found >> drop).astype(np.int64)
        maybe = np.flatnonzero((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        slot = np.minimum(np.searchsorted(keys, found[maybe]), len(keys) - 1)
        hit = keys[slot] == found[maybe]
        where, slot = maybe[hit], slot[hit]
        order = np.argsort(slot, kind="stable")
        where, slot = where[order], slot[order]
        new = np.append(True, (slot[1:] != slot[:-1]) | (where[1:] - where[:-1] > near))[:len(slot)]
        first = np.flatnonzero(new)
        return slot[first], where[first], where[np.append(first[1:], len(where))[:len(first)] - 1]

    def _shared(self, codes: np.ndarray, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item, place in it, and band, of every place of an item that stands in a band of diagonals; each once, item by
        item, some items at a time: as many as make MATCHES triples, or one."""
        keys, entry, count, item, place, *_ = self.by_q[q]
        slot, low, high = self._runs(codes, q)
        if not len(slot):
            return
        used = np.unique(slot)
        own = np.concatenate([np.arange(entry[s], entry[s] + count[s]) for s in used.tolist()])
        # how many triples an item makes: runs of its q-grams, and the bands they reach over
        runs, length = np.bincount(slot, minlength=len(keys)), np.bincount(slot, high - low, len(keys))
        of = np.repeat(used, count[used])
        each = np.bincount(item[own], 2 * runs[of] + length[of] / self.width[item[own]], len(self.ids))
        part = np.cumsum(each) // MATCHES
        begin = np.searchsorted(slot, np.arange(len(keys) + 1))
        own = own[np.argsort(part[item[own]], kind="stable")]
        for some in np.split(own, np.flatnonzero(np.diff(part[item[own]])) + 1):
            s = np.searchsorted(entry, some, side="right") - 1
            times = runs[s]
            which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[s], times)
            held = np.repeat(some, times)
            i, p = item[held], place[held]
            lo, hi = ((x[which] - p + self.longest) // self.width[i] for x in (low, high))
            n = hi - lo + 1
            band = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            yield np.repeat(i, n), np.repeat(p, n), band

    def regions(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, lowest diagonal and number of diagonals of every stretch of bands that, two neighbours together, have
        enough shared q-grams. A stretch is no wider than half its item, so it holds no two places that do not overlap."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        bands, places = len(codes) + self.longest + 2, self.longest + 1
        for q in self.by_q:
            for item, place, band in self._shared(codes, q):
                # a q-gram of the item counts once in a band, however often the text repeats it
                key = np.sort((item * bands + band) * places + place)
                key = key[np.append(True, key[1:] != key[:-1])[:len(key)]] // places
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
                keys, count = key[first], np.diff(np.append(first, len(key)))
                # a pair of bands is named by its lower one; the pair below the first of a run counts that band alone
                after = np.append(keys[1:] == keys[:-1] + 1, False)[:len(keys)]
                total = count + np.where(after, np.append(count[1:], 0)[:len(keys)], 0)
                alone = ~np.append(False, after[:-1])[:len(keys)]
                names, total = np.concatenate([keys, keys[alone] - 1]), np.concatenate([total, count[alone]])
                item, band = names // bands, names % bands
                on = total >= self.least[np.clip(item, 0, len(self.ids) - 1)]
                found.append((item[on], band[on]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        item, band = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((band, item))
        item, band = item[order], band[order]
        together = np.append(False, (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1))[:len(item)]
        start = np.maximum.accumulate(np.where(together, 0, np.arange(len(item))))
        most = np.maximum(1, np.array([len(c) for c in self.codes])[item] // (2 * self.width[item]) - 1)
        first = np.flatnonzero((np.arange(len(item)) - start) % most == 0)
        n = np.diff(np.append(first, len(item)))
        width = self.width[item[first]]
        return item[first], band[first] * width - self.longest, (n + 1) * width

    def align(
        self, codes: np.ndarray, items: np.ndarray, lows: np.ndarray, spans: np.ndarray
    ) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best place of each region, if it is within the budget.

        Rows are characters of the item, columns are diagonals: those of the region, and the budget on either side. A cell
        holds edits and start of its best path in one number, so that one minimum keeps both. Regions in which every path
        has used up the budget are left early.
        """
        order = np.lexsort((spans, items))
        for low in range(0, len(order), TOGETHER):
            part = order[low:low + TOGETHER]
            item, first = items[part], lows[part]
            edits = np.array([self.edits[i] for i in item])
            size = np.array([len(self.codes[i]) for i in item])
            width = int(spans[part].max() + 2 * edits.max() + 1)
            begin = first - edits
            pattern = np.full((len(part), int(size.max())), _OUTSIDE + 1, np.uint64)
            for row, i in enumerate(item):
                pattern[row, :len(self.codes[i])] = self.codes[i]
            diagonals = np.arange(width, dtype=np.int64)
            one = np.int64(1) << 32
            inserted = diagonals * one
            starts = begin[:, None] + diagonals
            inside = (starts >= 0) & (starts <= len(codes))
            far = np.int64(1) << 60
            cost = np.where(inside, np.clip(starts, 0, None), far)
            best = np.full(len(part), far)
            end = np.zeros(len(part), np.int64)
            live = np.arange(len(part))
            for i in range(pattern.shape[1]):
                if i % 16 == 15:
                    on = (cost.min(axis=1) >> 32 <= edits[live]) & (size[live] > i)
                    if not on.any():
                        break
                    if on.sum() < 0.8 * len(on):
                        live, cost, starts, pattern = live[on], cost[on], starts[on], pattern[on]
                at = starts + i
                there = (at >= 0) & (at < len(codes))
                char = np.where(there, codes[np.clip(at, 0, len(codes) - 1)], _OUTSIDE)
                # a text ends where no character stands: no path goes through
                through = np.where(char == _OUTSIDE, far, cost + np.where(char == pattern[:, i:i + 1], 0, one))
                left_out = np.concatenate([cost[:, 1:], np.full((len(live), 1), far)], axis=1) + one
                cost = np.minimum(through, left_out)
                blocked = char == _OUTSIDE
                run = np.minimum.accumulate(np.where(blocked, far, cost) - inserted, axis=1) + inserted
                cost = np.minimum(cost, np.where(blocked, far, run))
                done = np.flatnonzero(size[live] == i + 1)
                if len(done):
                    column, own = cost[done].argmin(axis=1), live[done]
                    best[own] = cost[done, column]
                    end[own] = begin[own] + column + i + 1
            for row in np.flatnonzero(best >> 32 <= edits):
                yield int(item[row]), int(best[row] & (one - 1)), int(end[row]), int(best[row] >> 32)

    def find(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits), of overlapping places of an item the one with the fewest edits."""
        if not self.ids or not len(codes):
            return []
        out: list[tuple[int, int, int, int]] = []
        own, starts, ends = None, [], []  # kept places of one item, in order
        for hit in sorted(self.align(codes, *self.regions(codes)), key=lambda h: (h[0], h[3], h[1], h[2])):
            item, start, end, _ = hit
            if self.short[item] and not (self._boundary(codes, start) and self._boundary(codes, end)):
                continue
            if item != own:
                own, starts, ends = item, [], []
            at = bisect_left(starts, end)  # the only kept place that can overlap is the last that starts before this ends
            if at and ends[at - 1] > start:
                continue
            starts.insert(at, start)
            ends.insert(at, end)
            out.append(hit)
        return out

    @staticmethod
    def _boundary(codes: np.ndarray, at: int) -> bool:
        """Whether no word goes on over this place."""
        if at <= 0 or at >= len(codes) or _OUTSIDE in (codes[at - 1], codes[at]):
            return True
        return not (chr(int(codes[at - 1])).isalnum() and chr(int(codes[at])).isalnum())

    def find_in(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Hits of every text: short texts side by side, long ones in pieces that overlap by more than an item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if not held:
                return
            gap = np.array([_OUTSIDE], np.uint64)
            joined = np.concatenate([x for _, _, c in held for x in (c, gap)])
            begins = np.cumsum([0] + [len(c) + 1 for _, _, c in held[:-1]])
            for item, start, end, edits in self.find(joined):
                at = int(np.searchsorted(begins, start, side="right")) - 1
                text, offset, _ = held[at]
                base = int(begins[at]) - offset
                hit = (item, start - base, end - base, edits)
                if not any(h[0] == item and h[1] < hit[2] and hit[1] < h[2] for h in out[text]):
                    out[text].append(hit)
            held.clear()

        overlap = 2 * self.longest + 2
        for k, text in enumerate(texts):
            codes = folded(text)
            step = max(PIECE_CHARS, 2 * overlap)
            for low in range(0, max(1, len(codes) - overlap), step):
                piece = codes[low:low + step + overlap]
                held.append((k, low, piece))
                size += len(piece)
                if size >= PIECE_CHARS:
                    flush()
                    size = 0
        flush()
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (or one item); null texts are empty."""
    block, size = [], 0
    for row in benchmark.select(named(id_col).cast("long").alias("i"), whole_text(text_col).alias("t")).toLocalIterator():
        if block and size + len(row["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


_indexes: dict[int, Index] = {}


def _index(shared) -> Index:
    """The index of a broadcast block, once per process; one block at a time is in use."""
    if shared.id not in _indexes:
        _indexes.clear()
        _indexes[shared.id] = Index(*shared.value)
    return _indexes[shared.id]


class _Shared:
    """A broadcast block and its number; `value` fetches it in the task."""

    def __init__(self, spark, value, number: int):
        self.held, self.id = spark.sparkContext.broadcast(value), number

    @property
    def value(self):
        return self.held.value


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, budget: float, shortest: int, columns: tuple[str, str]) -> list[_Shared]:
    return [
        _Shared(docs.sparkSession, (block, budget, shortest), uuid.uuid4().int) for block in blocks(benchmark, *columns)
    ]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: float = BUDGET,
         shortest: int = SHORTEST, item_columns: tuple[str, str] = ("item_id", "text")) -> DataFrame:
    """`doc_id`, `item_id`, `start`, `end`, `edits`, `short`: the places in whole texts where an item stands within its budget.

    Case does not count. Budget: `budget` edits per character of the item, rounded down. Items shorter than `shortest` are
    `short`, and found where no word goes on over their ends; empty ones are not found. Places are code points, end exclusive; of overlapping places of
    one item the one with the fewest edits counts. Null texts are empty. Rows repeated as a whole bring their hits each.
    """
    schema = "doc_id long, item_id long, start long, end long, edits long, short boolean"
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in _shared_blocks(docs, benchmark, budget, shortest, item_columns):
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                rows = [
                    (doc, index.ids[item], start, end, edits, index.short[item])
                    for doc, places in zip(batch.column(0).to_pylist(), index.find_in(batch.column(1).to_pylist()))
                    for item, start, end, edits in places
                ]
                columns = list(zip(*rows)) or [()] * 6
                types = [pa.int64()] * 5 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "start", "end", "edits", "short"]
                )

        found = found.unionAll(
            docs.select(named(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
        )
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", budget: float = BUDGET, shortest: int = SHORTEST,
          item_columns: tuple[str, str] = ("item_id", "text"), with_short: bool = False) -> DataFrame:
    """`docs` without the rows in which an item stands; every other row and all columns stay as they are.

    A short item in a text says little, so it removes the row only `with_short`.
    """
    def leaks_into(text: Column, shared: _Shared) -> Column:
        @F.pandas_udf("boolean")
        def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = _index(shared)
            for part in parts:
                found = index.find_in(list(part))
                yield pd.Series([any(with_short or not index.short[h[0]] for h in hits) for hits in found], dtype=bool)

        return leaks(text)

    for shared in _shared_blocks(docs, benchmark, budget, shortest, item_columns):
        docs = docs.filter(~leaks_into(whole_text(text_col), shared))
    return docs
