"""Byte-level BPE encoding and decoding on padded numpy matrices.

The pieces a text splits into are encoded once per block of text. Pieces of similar length share a matrix, one row each,
padded on the right. In every round each row merges its leftmost pair of least rank; ranks come from a hash table of id
pairs that all rows probe at once. Rows without a pair left leave the matrix, and the others move together.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from statelake.llm.common import named, whole_text

NONE = np.int32(2**31 - 1)
#: Pieces longer than this are merged with a heap: a matrix row takes time with the square of its length.
ROW_BYTES = 1024
#: Characters of text whose pieces are held at a time, and pieces remembered between blocks.
BLOCK_CHARS, REMEMBERED = 1 << 20, 200_000
#: Rows of a batch that go out together.
ROWS_OUT = 500
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, ROW_BYTES)
WIDTH_OF = [next(w for w in WIDTHS if w >= n) for n in range(ROW_BYTES + 1)]


class Ranks:
    """Tokens of a rank file (base64 and rank per line), and the hash table of the pairs that merge."""

    def __init__(self, file: bytes):
        self.id_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        size = 1 + max(self.id_of.values())
        self.bytes_of = [b""] * size
        for token, number in self.id_of.items():
            self.bytes_of[number] = token
        self.text_of = [str(k) for k in range(size)]
        self.numbers = list(range(size))
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.base = np.int64(size)
        pairs = {}
        for token, number in self.id_of.items():
            for cut in range(1, len(token)):
                left, right = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = number
        self._fill(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.longest = 0
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slots], self.ranks[slots] = keys[won], ranks[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask
            self.longest += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where a pair does not merge or an id is below 0 (padding)."""
        keys = left.astype(np.int64) * self.base + right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (held >= 0)
            open_, at = open_[go], at[go]
        out[(left < 0) | (right < 0)] = NONE
        return out

    # -- encoding ---------------------------------------------------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; an empty piece has none."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.id_of.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > ROW_BYTES:
                out[k] = self._by_heap(piece)
            elif piece:
                buckets.setdefault(WIDTH_OF[len(piece)], []).append(k)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for low in range(0, len(rows), step):
                part = rows[low:low + step]
                for k, ids in zip(part, self._matrix([pieces[r] for r in part], width)):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        row = np.arange(len(pieces))
        out: list[list[int]] = [[]] * len(pieces)

        def leave(rows: np.ndarray, lines: np.ndarray, sizes: np.ndarray) -> None:
            for r, line, n in zip(rows.tolist(), lines.tolist(), sizes.tolist()):
                out[r] = line[:n]

        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            all_rows = np.arange(len(row))
            best = ranks[all_rows, at] if ranks.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                leave(row[done], ids[done], size[done])
                stay = ~done
                width = int(size[stay].max()) if stay.any() else 0
                row, size, at, best = row[stay], size[stay], at[stay], best[stay]
                ids, ranks = ids[stay, :width], ranks[stay, :max(0, width - 1)]
                if not len(row):
                    break
                all_rows = np.arange(len(row))
            # the pair gives way to its token; what stands behind it moves one place to the left
            width = ids.shape[1]
            moved = np.arange(width - 1) >= (at + 1)[:, None]
            ids[all_rows, at] = best
            ids = np.where(moved, ids[:, 1:], ids[:, :-1])
            ranks = np.where(np.arange(width - 2) >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            size = size - 1
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < size - 1)
            ranks[has, at[has]] = self.rank(ids[has, at[has]], ids[has, at[has] + 1])
            end = np.flatnonzero((at >= size - 1) & (at < ranks.shape[1]))
            ranks[end, at[end]] = NONE
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        """The same merges in the same order, for a long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        table = self._pairs()
        base, n = int(self.base), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := table.get(ids[k] * base + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, left, right = heapq.heappop(heap)
            nxt = after[k] if ids[k] == left else n
            if nxt >= n or ids[nxt] != right:
                continue
            ids[k], ids[nxt] = r, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (rank := table.get(ids[a] * base + ids[b])) is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def _pairs(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            used = self.keys >= 0
            self._table = dict(zip(self.keys[used].tolist(), self.ranks[used].tolist()))
        return self._table


class Codec:
    """Encodes and decodes texts block by block; remembers the ids of pieces between blocks."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern, self.known = ranks, regex.compile(pattern), {}

    def learn(self, pieces: Iterable[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        same = self.ranks.numbers.__getitem__  # one int object for each id, however often it is remembered
        for piece, ids in zip(new, self.ranks.encode_pieces([p.encode("utf-8") for p in new])):
            self.known[piece] = tuple(map(same, ids))

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of `text`, some ten thousand pieces at a time."""
        matches = self.pattern.finditer(text)
        while pieces := [m.group() for m in islice(matches, 100_000)]:
            self.learn(pieces)
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def encode(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """For each text an iterator over blocks of ids; the pieces of many short texts are encoded together."""
        batch: list[str] = []
        held = 0
        for text in texts:
            batch.append(text)
            held += len(text)
            if held >= BLOCK_CHARS:
                yield from self._together(batch)
                batch, held = [], 0
        yield from self._together(batch)

    def _together(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        cut = [self.pattern.findall(t) if len(t) < BLOCK_CHARS else None for t in texts]
        self.learn(chain.from_iterable(c for c in cut if c is not None))
        for text, pieces in zip(texts, cut):
            if pieces is None:  # fills blocks of its own, and may clear what is remembered
                yield self.blocks(text)
                self.learn(chain.from_iterable(c for c in cut if c is not None))
            else:
                yield iter((list(chain.from_iterable(map(self.known.__getitem__, pieces))),))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec_of(file: bytes, pattern: str) -> Codec:
    """One codec per process and vocabulary."""
    key = (hashlib.sha256(file).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(Ranks(file), pattern)
    return _codecs[key]


def encode_column(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", id_col: str = "doc_id",
                  with_ids: bool = True) -> DataFrame:
    """`doc_id`, `ids` (unless `with_ids` is off), `n_tokens`, `ids_sha256`, `decoded_sha256`, one row per row.

    Every match of `pattern` is encoded by itself, without special tokens; characters no match covers have no ids. A null
    or empty text has no ids: the digests are those of nothing. Ids are decoded again and the digest is taken of the bytes
    that come out. The rank file (below a few MB) is read by the driver and broadcast; texts of any length are worked on in
    blocks.
    """
    spark: SparkSession = docs.sparkSession
    with open(rank_file, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value, pattern)
        word = codec.ranks.text_of
        for batch in (b.slice(low, ROWS_OUT) for b in batches for low in range(0, b.num_rows, ROWS_OUT)):
            count, told, back, kept = [], [], [], []
            for blocks in codec.encode(batch.column(1).to_pylist()):
                n, told_hash, back_hash, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in blocks:
                    if not ids:
                        continue
                    if n:
                        told_hash.update(b" ")
                    told_hash.update(" ".join(map(word.__getitem__, ids)).encode())
                    back_hash.update(codec.decode(ids))
                    n += len(ids)
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                count.append(n)
                told.append(told_hash.hexdigest())
                back.append(back_hash.hexdigest())
                kept.append(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32))
            arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(named(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def decode_column(encoded: DataFrame, rank_file: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """`doc_id` and `text` of rows of ids; bytes that are no UTF-8 become replacement characters, null ids an empty text."""
    spark = encoded.sparkSession
    with open(rank_file, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value, "")
        for batch in batches:
            texts = [codec.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(named(id_col).cast("long").alias("doc_id"), named(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )
