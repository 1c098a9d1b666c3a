"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the set of its shingles of five words, for the bands and for the links alike: how often it repeats one does not
count. Every shingle is a Poisson process of rate 1 (its count, where `signatures` is given repeats); each arrival falls
into one of the registers, and a register keeps the shingle of its first arrival. Two texts agree in a register with the
Jaccard similarity of their sets. Arrivals of a shingle ascend, so a shingle stops as soon as its next one is later than
every register of its text.

Bands of registers put texts into buckets. Of a bucket the most central member (the one whose buckets are largest) is
compared with the others, by the exact Jaccard similarity of shingle sets. Where a bucket still holds members of different
classes, it is cut into cells of bounded size that compare all their members inside a task and emit only the links that
join two classes. So every pair of a bucket has been compared or is in one class, no pairs of a group are emitted, and no
bucket is capped.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statelake.llm.common import fresh, named, stored, stored_with, whole_text

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
#: Bytes of words worked on at a time, words of a piece, and shingle sets remembered by a comparing task.
CHUNK_BYTES, PIECE_WORDS, REMEMBERED = 1 << 20, 50_000, 64
#: Members and bytes of text in a block of a bucket; a cell holds two blocks. At most 32,768 members.
BLOCK_MEMBERS, BLOCK_BYTES = 2048, 2 << 20
#: Bits of the bitmap that keeps texts without a partner in any bucket out of a shuffle (8 MB).
FILTER_BITS = 26

WORD = re.compile(r"\w+")
_BITS = np.uint64((1 << 48) - 1)
_BASE = 0x5851F42D4C957F2D


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and their inverses."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Owner (place in `texts`) and 48-bit hash of every shingle, in order; words are runs of letters, digits and `_`,
    lower-cased. A text of fewer words, but one or more, is one shingle; a text without words has none.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    part, owners, size = [], [], 0
    for k, text in enumerate(texts):
        found_words = WORD.findall(text.lower())
        # a long text is taken in pieces that share the words of a shingle but one
        for low in range(0, max(1, len(found_words) - words + 1), PIECE_WORDS):
            part.append(" ".join(found_words[low:low + PIECE_WORDS + words - 1]).encode("utf-8", "replace"))
            owners.append(k)
            size += len(part[-1])
            if size >= CHUNK_BYTES:
                found.append(_shingles(part, np.array(owners), words))
                part, owners, size = [], [], 0
    if part:
        found.append(_shingles(part, np.array(owners), words))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _shingles(rows: list[bytes], owners: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` of rows of words with single spaces between; `owners` by row."""
    raw = np.frombuffer(b" ".join(rows) + b" ", np.uint8)
    power, inverse = _powers(1 << max(12, (len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    first_byte = np.cumsum(size + 1) - (size + 1)
    ends = np.flatnonzero(raw == 32)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    owner = np.repeat(np.arange(len(rows)), np.searchsorted(ends, first_byte + size, "right") - np.searchsorted(ends, first_byte, "left"))
    filled = ends > starts  # texts without words leave an empty one
    starts, ends, owner = starts[filled], ends[filled], owner[filled]
    count = np.bincount(owner, minlength=len(rows))
    last = np.cumsum(count)[owner] - 1  # last word of the owner
    at = np.arange(len(starts))
    begins = (at + words - 1 <= last) | ((at == 0) | (owner != np.roll(owner, 1)))
    at = at[begins]
    until = ends[np.minimum(at + words - 1, last[begins])]
    value = (sums[until] - sums[starts[at]]) * inverse[starts[at]]
    return owners[owner[begins]], _mixed(value) & _BITS


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """`shingles` without repeats, by owner and value; at most 65,536 texts at a time."""
    owner, value = shingles(texts, words)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(48)) | value)
    return (keys >> np.uint64(48)).astype(np.int64), keys & _BITS


def signatures(owner: np.ndarray, shingle: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers by text: the shingle of the first arrival; all ones for texts without shingles.

    Repeats of a shingle are its weight. At most 65,536 texts at a time.
    """
    keys, weight = np.unique((owner.astype(np.uint64) << np.uint64(48)) | shingle, return_counts=True)
    owner, shingle = (keys >> np.uint64(48)).astype(np.int64), keys & _BITS
    first = np.full(texts * registers, np.inf)
    holder = np.full(texts * registers, np.uint64(2**64 - 1))
    time = np.zeros(len(keys))
    arrival = 0
    while len(shingle):
        # few processes left: several arrivals of each at once
        many = int(np.clip(4096 // len(shingle), 1, 64))
        step = np.uint64(arrival) + np.arange(many, dtype=np.uint64)
        seed = _mixed(shingle[:, None] * np.uint64(0x9E3779B97F4A7C15) + step * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
        gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        when = time[:, None] + np.cumsum(gap, axis=1)
        slot = ((_mixed(seed) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        place = (owner[:, None] * registers + slot.astype(np.int64)).ravel()
        flat = when.ravel()
        np.minimum.at(first, place, flat)
        won = first[place] == flat
        holder[place[won]] = np.repeat(shingle, many)[won]
        arrival += many
        time = when[:, -1]
        latest = first.reshape(texts, registers).max(axis=1)
        on = time < latest[owner]
        owner, shingle, weight, time = owner[on], shingle[on], weight[on], time[on]
    return holder.reshape(texts, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per text and band."""
    values = registers[:, :bands * rows].reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), bands)).copy()
    for r in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key.view(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or k - low >= 20_000:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def band_rows(nodes: DataFrame) -> DataFrame:
    """`node`, `bands` of rows (node, text); texts without words have no bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _chunks(texts):
                owner, shingle = shingle_sets(texts[low:high])
                keys = band_keys(signatures(owner, shingle, high - low))
                has = np.bincount(owner, minlength=high - low) > 0
                lists = pa.ListArray.from_arrays(
                    np.append(0, np.cumsum(has * BANDS)).astype(np.int32), pa.array(keys[has].ravel(), pa.int64())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], names=["node", "bands"])

    return nodes.select("node", "text").mapInArrow(run, "node binary, bands array<long>")


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of `pairs` (a, b) those whose texts (node, text) have Jaccard similarity `least` or more; `a`, `b`, `similarity`."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(node: bytes, text: str) -> np.ndarray:
            if node not in known:
                known[node] = shingle_sets([text])[1]
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            found = ([], [], [])
            for low in range(0, batch.num_rows, 256):
                for row in batch.slice(low, 256).to_pylist():
                    x, y = of(row["a"], row["ta"]), of(row["b"], row["tb"])
                    small, large = min(len(x), len(y)), max(len(x), len(y))
                    if not small or small < least * large:
                        continue
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if shared >= least * (small + large - shared) - 1e-9:
                        for column, v in zip(found, (row["a"], row["b"], shared / (small + large - shared))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.binary()), pa.array(found[1], pa.binary()), pa.array(found[2], pa.float64())],
                names=["a", "b", "similarity"],
            )

    return both.mapInArrow(run, "a binary, b binary, similarity double")


def cell_links(members: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Links that join classes inside buckets, of `members` (b, node, class): `a`, `b`, `similarity`.

    The members of a bucket are dealt into blocks by a hash, and a cell compares two blocks of a bucket (or one with
    itself) inside its task by counts over shared shingles. It emits links that join two classes and no other pairs. Blocks
    are as many as keep their members and their text below the bounds; a small bucket is one cell.
    """
    held = stored(members.join(texts, "node").select("b", "node", "class", "text"), "cell-texts")
    size = F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    blocks = stored(held.groupBy("b").agg(F.ceil(size).cast("int").alias("n")), "blocks")
    mine = F.pmod(F.xxhash64("node", "b"), F.col("n")).cast("int")
    others = F.sequence(F.lit(0), F.col("n") - 1)
    dealt = held.join(blocks, "b").withColumn("mine", mine).withColumn("other", F.explode(others)).select(
        "b", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "class", "text"
    )

    def compare(cell: pa.Table) -> pa.Table:
        found = _joining(cell, least)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({
            "a": pa.array(columns[0], pa.binary()), "b": pa.array(columns[1], pa.binary()),
            "similarity": pa.array(columns[2], pa.float64()),
        })

    return dealt.groupBy("b", "i", "j").applyInArrow(compare, "a binary, b binary, similarity double")


def _joining(cell: pa.Table, least: float) -> list[tuple[bytes, bytes, float]]:
    """Links of a cell that join classes; a pair is looked at only while its classes are apart."""
    nodes, names = cell.column("node").to_pylist(), cell.column("class").to_pylist()
    block = cell.column("mine").to_numpy()
    number = {c: k for k, c in enumerate(dict.fromkeys(names))}
    group = np.array([number[c] for c in names], np.int64)
    owner, value = shingle_sets(cell.column("text").to_pylist())
    size = np.bincount(owner, minlength=len(nodes))
    start = np.append(0, np.cumsum(size))
    _, word, many = np.unique(value, return_inverse=True, return_counts=True)
    holders = owner[np.argsort(word, kind="stable")]
    first = np.cumsum(many) - many
    same_block = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
    found = []
    for x in range(len(nodes)):
        if not size[x] or (group == group[x]).all():
            continue
        mine = word[start[x]:start[x + 1]]
        times = many[mine]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[mine], times)
        shared = np.bincount(holders[at], minlength=len(nodes))
        near = (shared > 0) & (shared >= least * (size[x] + size - shared) - 1e-9)
        for y in np.flatnonzero(near):
            if group[y] != group[x] and (same_block or block[y] != block[x]):
                found.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y]), shared[y] / (size[x] + size[y] - shared[y])))
                group[group == group[y]] = group[x]
    return found


def components(links: DataFrame) -> DataFrame:
    """`node`, `class` (least node) of every node of `links` (a, b): large-star and small-star steps until nothing moves.

    Minima are aggregated in every task first, and stored before they are joined, so that AQE can split a hot node.
    """
    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, stored, and a mark of them: their number and the sum of their hashes."""
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        return stored_with(e.filter("u <> v").distinct(), "links", F.count(F.lit(1)), total)

    def large(edges: DataFrame) -> DataFrame:
        """Larger neighbours of u go to the least of u's neighbourhood."""
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star")
        return both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")

    def small(edges: DataFrame) -> DataFrame:
        """Smaller neighbours of v, and v itself, go to the least of them."""
        least = stored(edges.groupBy("v").agg(F.min("u").alias("m")), "star")
        moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
        return moved.unionAll(least.select(F.col("m").alias("u"), "v"))

    edges, mark = kept(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    marks = [mark]
    while not (len(marks) > 2 and marks[-1] == marks[-2] == marks[-3]):
        edges, mark = kept((large if len(marks) % 2 else small)(edges))
        marks.append(mark)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("class")).unionAll(
        edges.select(F.col("u").alias("node"), F.col("u").alias("class"))
    ).distinct()


def _maybe_among(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `nodes` whose node may be one of `wanted`: by a bitmap of hashes, of fixed size whatever the input.

    It keeps the text of most other nodes out of the shuffle of the join that follows and decides.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    width = 1 << 15  # bits of one bitmap of Spark
    maps = wanted.select(place.alias("h")).groupBy(F.floor(F.col("h") / width).alias("k")).agg(
        F.bitmap_construct_agg(F.col("h") % width).alias("bits")
    ).collect()
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in maps:
        table[row["k"] * width // 8:(row["k"] + 1) * width // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = nodes.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(shared.value, np.uint8)
        for part in parts:
            at = part.to_numpy(np.int64)
            yield pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return nodes.filter(held(place))


def linked(nodes: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between different texts of `nodes` (node, text), and their components.

    Links are as many as the components need: members of a bucket that already are in one class are not compared again.
    """
    spark = nodes.sparkSession
    # copies of a text have the same bands
    bands = stored(band_rows(nodes).groupBy("node").agg(F.first("bands").alias("bands")), "bands")
    members = bands.select("node", F.explode("bands").alias("b"))
    sizes = stored(members.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = stored(members.join(sizes, "b"), "members")
    weight = stored(members.groupBy("node").agg(F.sum("n").alias("w")), "centrality")
    members, (many,) = stored_with(
        members.join(weight, "node").select("b", "node", "w", F.col("node").alias("class")), "members", F.count(F.lit(1))
    )
    few = _maybe_among(nodes.select("node", "text"), weight)
    # one copy per task leaves for the shuffle, before the join decides
    texts = stored(
        few.groupBy("node").agg(F.first("text").alias("text")).join(weight.select("node"), "node", "left_semi"), "near-texts"
    )
    # every member against the most central one of its bucket
    best = members.groupBy("b").agg(F.max(F.struct("w", "node")).alias("x"))
    heads = stored(best.select("b", F.col("x.node").alias("head")), "heads")
    pairs = members.join(heads, "b").filter("node <> head").select(
        F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")
    ).distinct()
    links, (many,) = stored_with(similar_pairs(pairs, texts, least), "links", F.count(F.lit(1)))
    classes = components(links) if many else spark.createDataFrame([], "node binary, class binary")
    # where a bucket holds several classes, all of its members, in cells of bounded size
    known = members.select("b", "node").join(stored(classes, "classes"), "node", "left")
    known = stored(known.select("b", "node", F.coalesce("class", "node").alias("class")), "members")
    mixed = known.groupBy("b").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    left, (many,) = stored_with(known.join(mixed.select("b"), "b"), "mixed", F.count(F.lit(1)))
    if many:
        links, (more,) = stored_with(links.unionAll(cell_links(left, texts, least)), "links", F.count(F.lit(1)))
        classes = components(links)
    return links, classes


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `class_id` (least id of its class), `class_size`, `kept`, `node`, `class`.

    Texts that are equal, or linked by similarity `least` or more over shingles of five words, are one class; null counts
    as empty, and all empty texts are one class. Null ids are larger than others: a class of null ids only has a null
    `class_id`. `node` is the digest of the text, `class` a digest that names the class. `kept` marks the row with the
    least id; rows repeated as a whole are marked alike.
    """
    text = whole_text(text_col)
    base = docs.select(named(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))
    _, classes = linked(base.select("node", "text"), least)
    rows = base.select("doc_id", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = stored(rows, "near-rows")
    # the row that stays: least id, then least text digest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    groups = stored(rows.groupBy("class").agg(first.alias("x"), F.count(F.lit(1)).alias("class_size")), "near-groups")
    joined = rows.join(groups, "class")
    return joined.select(
        "doc_id", F.col("x.doc_id").alias("class_id"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("node") == F.col("x.node"))).alias("kept"), "node", "class",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """`docs` with one row of each class of near-duplicates, that of the least id; all columns as they were."""
    kept = near_classes(docs, id_col, text_col, least).filter("kept").select("node", "doc_id").distinct()
    node, other_node, other_id = fresh(docs, "node", "kept_node", "kept_id")
    kept = stored(kept.toDF(other_node, other_id), "near-kept")
    marked = docs.withColumn(node, F.unhex(F.md5(whole_text(text_col).cast("binary"))))
    same = (F.col(node) == F.col(other_node)) & named(id_col).cast("long").eqNullSafe(F.col(other_id))
    return marked.join(kept, same, "left_semi").dropDuplicates([node]).drop(node)
