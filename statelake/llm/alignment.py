"""Cross-tokenizer alignment: groups of tokens that end together, and links scored by inverted pair bitmaps.

Two tokenizers cut the bytes of a text at different places. Where both have a cut, a group ends; tokens whose bytes
overlap are linked. What two ids have in common over a corpus is held by pair, not by document: documents are numbered
inside chunks, and a pair has, in each chunk, a compressed bitmap of the documents in which it is linked, and bitmaps of
the planes of its further links there (bit p of multiplicity - 1). Bitmaps of a pair are ORed chunk by chunk, and their
popcounts summed are its count of documents. The same postings carry the scores back: a bitmap of plane p adds 2^p times
its pair's score to every document in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from statelake.llm.common import named, stored, whole_text
from statelake.llm.token_ids import encoder, vocabulary_bytes

#: A chunk ends after so many documents (places in it are 16-bit numbers) or postings.
CHUNK_DOCS, CHUNK_POSTINGS = 1 << 16, 1 << 20
#: Characters of text whose links are found at a time.
BLOCK_CHARS = 1 << 20
CHUNK_BITS = 24
#: First byte of a bitmap: places as 16-bit numbers, or one bit per place.
PLACES, BITS = b"\0", b"\1"
DOC_COLUMNS = ["chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
_SCHEMA = (
    "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pair long, plane int, bitmap binary"
)
_TYPES = dict(zip(
    [part.split()[0] for part in _SCHEMA.split(", ")],
    [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int32(), pa.binary()],
))


# -- tokens ----------------------------------------------------------------------------------------------------------


class ByteLevelSide:
    """Tokens of a byte-level tokenizer file over a blank and the text."""

    def __init__(self, file: bytes):
        self.encode_one = encoder(file, plain_specials=True)
        self.bytes_of = vocabulary_bytes(self.encode_one.spec)

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        arrays = [self.encode_one(" " + t).astype(np.int64) for t in texts]
        return [(a.tolist(), a) for a in arrays]


class PieceSide:
    """Tokens of a sentence-piece model, which puts the blank in front of the text itself."""

    _BYTE = re.compile(r"<0x([0-9A-F]{2})>")

    def __init__(self, file: bytes):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.bytes_of = []
        for i in range(self.made.get_piece_size()):
            piece = self.made.id_to_piece(i)
            byte = self._BYTE.fullmatch(piece)
            self.bytes_of.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        return [(ids, np.array(ids, np.int64)) for ids in self.made.encode(texts, num_threads=1)]


_sides: dict[tuple[type, bytes], object] = {}


def side(kind: type, file: bytes):
    key = kind, hashlib.sha256(file).digest()
    if key not in _sides:
        made = kind(file)
        made.size_of = np.fromiter(map(len, made.bytes_of), np.int64, len(made.bytes_of))
        _sides[key] = made
    return _sides[key]


_numbers: list[str] = []


def numbers(size: int) -> list[str]:
    """Texts of ids with what may follow them: of id i at 3 i, 3 i + 1 and 3 i + 2."""
    _numbers.extend(f"{i}{end}" for i in range(len(_numbers) // 3, size) for end in ",|;")
    return _numbers


# -- links -----------------------------------------------------------------------------------------------------------


class Ends:
    """Where the tokens of two sides end over the same bytes, as masks by byte, and what follows from them."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        size = int(a_ends[-1]) + 1
        self.a_ends, self.b_ends = a_ends, b_ends
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[a_ends], in_b[b_ends] = True, True
        self.a_count, self.b_count = np.cumsum(in_a, dtype=np.int32), np.cumsum(in_b, dtype=np.int32)
        self.in_both = in_a & in_b
        self.shared, self.either = np.flatnonzero(self.in_both), np.flatnonzero(in_a | in_b)
        self.in_a, self.in_b = in_a, in_b

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of the left and of the right token of every link.

        Between two neighbouring ends of either side exactly one token of each side reaches, and two tokens that overlap
        do so in one such stretch, so the ends of both sides taken together are the links.
        """
        at = self.either
        return self.a_count[at] - self.in_a[at], self.b_count[at] - self.in_b[at]

    def text(self, a: np.ndarray, b: np.ndarray, strings: list[str]) -> str:
        """Groups as `a1,a2|b1;a3|b2`: ids of the left, ids of the right, group by group."""
        group = np.cumsum(self.in_both, dtype=np.int32)
        a_last, b_last = self.in_both[self.a_ends], self.in_both[self.b_ends]
        a_group, b_group = group[self.a_ends] - a_last, group[self.b_ends] - b_last
        b_before = np.r_[0, self.b_count[self.shared]]  # right tokens of earlier groups
        a_until = self.a_count[self.shared]  # left tokens up to the end of a group
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + b_before[a_group]] = 3 * a + a_last
        out[np.arange(len(b)) + a_until[b_group]] = 3 * b + 2 * b_last
        return "".join([strings[i] for i in out.tolist()])[:-1]


# -- bitmaps ---------------------------------------------------------------------------------------------------------


def bitmaps(places: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A bitmap per run of ascending places (runs begin at `starts`), in the form that needs fewer bytes."""
    raw = places.astype("<u2").tobytes()
    ends = np.append(starts[1:], len(places))
    top = places[ends - 1]
    dense = 2 * (ends - starts) > top // 8 + 1
    out = [PLACES + raw[2 * lo:2 * hi] for lo, hi in zip(starts.tolist(), ends.tolist())]
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(int(top[k]) + 1, np.uint8)
        bits[places[starts[k]:ends[k]]] = 1
        out[k] = BITS + np.packbits(bits, bitorder="little").tobytes()
    return out


def places_of(bitmap: bytes) -> np.ndarray:
    if bitmap[:1] == PLACES:
        return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))


def popcount(bitmap: bytes) -> int:
    if bitmap[:1] == PLACES:
        return (len(bitmap) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, np.uint8, offset=1)).sum(dtype=np.int64))


# -- Spark -----------------------------------------------------------------------------------------------------------


def alignments(
    docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of documents (`pair` is null) and postings (`pair` is not), one pass over the texts.

    Documents: `chunk` and `place` (their number), `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `groups` (see
    `Ends.text`). Texts that are null or empty, or whose tokens of one side do not spell a blank and the text, have no
    tokens: zeros and an empty string. Each row is a document of its own, also where ids repeat; null ids stay null.
    Postings: `chunk`, `pair` (left id * 2^32 + right id), `plane` (-1: the documents of the pair; p: those in which bit p
    of its links - 1 is set), `bitmap`. A task holds the postings of one chunk and the tokens of one block of texts or one
    longer text.
    """
    context = docs.sparkSession.sparkContext
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            files.append(context.broadcast(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = side(ByteLevelSide, files[0].value), side(PieceSide, files[1].value)
        chunk, place, held, n_held = TaskContext.get().partitionId() << CHUNK_BITS, 0, [], 0
        for batch in batches:
            for part in _text_blocks(batch):
                ids, texts = part.column(0), part.column(1).to_pylist()
                rows, postings = _block(texts, left, right, place)
                yield _rows(chunk=[chunk] * len(texts), place=range(place, place + len(texts)), doc_id=ids, **rows)
                held.append(postings)
                place, n_held = place + len(texts), n_held + len(postings[0])
                if n_held >= CHUNK_POSTINGS or place > CHUNK_DOCS - _MOST_ROWS:
                    yield from _postings(chunk, held, len(right.bytes_of))
                    chunk, place, held, n_held = chunk + 1, 0, [], 0
        yield from _postings(chunk, held, len(right.bytes_of))

    source = docs.select(named(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, _SCHEMA)


_MOST_ROWS = 256


def _text_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    low = size = 0
    for k, n in enumerate(sizes):
        if k > low and (size + n > BLOCK_CHARS or k - low == _MOST_ROWS):
            yield batch.slice(low, k - low)
            low, size = k, 0
        size += n
    if low < batch.num_rows:
        yield batch.slice(low)


def _block(texts: list[str], left, right, first: int) -> tuple[dict, tuple[np.ndarray, np.ndarray]]:
    """Columns of the documents of a block, and its postings: (left id * ids of the right + right id) * 2^16 + place,
    ascending, and the number of links of each."""
    n, many = len(texts), len(right.bytes_of)
    out = {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": [""] * n}
    full = [k for k in range(n) if texts[k]]
    some = [texts[k] for k in full]
    strings = numbers(max(len(left.bytes_of), many))
    of_a, of_b = left.bytes_of.__getitem__, right.bytes_of.__getitem__
    keys = []
    for k, text, (a_ids, a), (b_ids, b) in zip(full, some, left.encode(some), right.encode(some)):
        raw = b" " + text.encode()
        if b"".join(map(of_b, b_ids)) != raw or b"".join(map(of_a, a_ids)) != raw:
            continue
        ends = Ends(np.cumsum(left.size_of[a]), np.cumsum(right.size_of[b]))
        at_a, at_b = ends.links()
        out["n_a"][k], out["n_b"][k], out["n_groups"][k], out["n_links"][k] = len(a), len(b), len(ends.shared), len(at_a)
        out["groups"][k] = ends.text(a, b, strings)
        keys.append(((a[at_a] * many + b[at_b]) << 16) | (first + k))
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return out, (key[start], np.diff(np.r_[start, len(key)]))


def _postings(chunk: int, held: list[tuple[np.ndarray, np.ndarray]], many: int) -> Iterator[pa.RecordBatch]:
    """The bitmaps of a chunk: of every pair, its documents and the planes of its further links.

    Blocks hold different places, so ORing the bitmaps of a pair from block to block is putting its places together.
    """
    if not held:
        return
    key, times = (np.concatenate(column) for column in zip(*held))
    order = np.argsort(key)
    key, more = key[order], times[order] - 1
    pair, place = key >> 16, key & 0xFFFF
    for plane in range(-1, int(more.max(initial=0)).bit_length()):
        inside = slice(None) if plane < 0 else ((more >> plane) & 1).astype(bool)
        p, at = pair[inside], place[inside]
        if len(p):
            start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            made, own = bitmaps(at, start), p[start]
            own = ((own // many) << 32) | (own % many)
            for low in range(0, len(start), 1 << 16):
                part = made[low:low + (1 << 16)]
                yield _rows(chunk=[chunk] * len(part), pair=own[low:low + (1 << 16)], plane=[plane] * len(part), bitmap=part)


def _rows(**columns) -> pa.RecordBatch:
    n = len(columns["chunk"])
    return pa.RecordBatch.from_arrays(
        [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t)
         for c, t in _TYPES.items()], names=list(_TYPES),
    )


def pair_counts(postings: DataFrame) -> DataFrame:
    """`pair`, `n_docs`, `best`: documents that hold the pair linked, and whether no pair of its left id has more.

    Bitmaps of different chunks have no document in common, so the popcount of all of them ORed is the sum of theirs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [popcount(b) for b in batch.column("bitmap").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(counts, pa.int64())], names=["pair", "n"])

    own = postings.filter("plane = -1").select("pair", "bitmap").mapInArrow(run, "pair long, n long")
    counts = stored(own.groupBy("pair").agg(F.sum("n").alias("n_docs")), "pair-counts")
    left = F.shiftrightunsigned("pair", 32)
    most = counts.groupBy(left.alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.join(most.hint("merge"), left == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """`chunk`, `place`, `n_best`, `count_sum` of every document with links, summed over the bitmaps of its chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "place", "n_best", "count_sum"]
        current, sums = None, None

        def close() -> pa.RecordBatch:
            at = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), current)), pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])],
                names=names,
            )

        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            times = np.int64(1) << np.maximum(batch.column("plane").to_numpy(), 0).astype(np.int64)
            n_docs, best = batch.column("n_docs").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            maps = batch.column("bitmap").to_pylist()
            cut = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]) if len(chunks) else np.empty(0, np.int64)
            for low, high in zip(cut.tolist(), np.r_[cut[1:], len(chunks)].tolist()):
                if current != chunks[low]:
                    if current is not None:
                        yield close()
                    current, sums = chunks[low], np.zeros((2, CHUNK_DOCS), np.int64)
                for lo in range(low, high, 4096):
                    hi = min(high, lo + 4096)
                    places = [places_of(m) for m in maps[lo:hi]]
                    each = np.fromiter(map(len, places), np.int64, hi - lo)
                    at = np.concatenate(places)
                    np.add.at(sums[0], at, np.repeat(times[lo:hi] * best[lo:hi], each))
                    np.add.at(sums[1], at, np.repeat(times[lo:hi] * n_docs[lo:hi], each))
        if current is not None:
            yield close()

    # the same joins at every size: a broadcast of small counts would make small inputs look cheaper than they are
    scored = postings.join(counts.hint("merge"), "pair").select("chunk", "plane", "bitmap", "n_docs", "best")
    return scored.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        run, "chunk long, place int, n_best long, count_sum long"
    )


def score_links(aligned: DataFrame) -> DataFrame:
    """The documents of `alignments` (further columns stay) with `n_best`, the links whose pair is a best one of its left
    id, ties included, and `count_sum`, the documents of its pair summed over all links."""
    rows = stored(aligned, "alignments")
    postings = rows.filter("pair is not null").select("chunk", "pair", "plane", "bitmap")
    found = scores(postings, pair_counts(postings))
    none = F.lit(0).cast("long")
    return rows.filter("pair is null").drop("pair", "plane", "bitmap").join(found, ["chunk", "place"], "left").withColumns({
        "n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none),
    })
