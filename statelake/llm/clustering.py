"""Centroid clustering on bit planes: exact distances from AND and popcount.

The components of a vector are integers in two's complement. Bit i of all 64 components is one unsigned 64-bit word, the
plane i of the vector, so a vector of small integers is a few words. The dot product with a centroid is the sum over pairs
of planes of 2^(i + j) times the number of bits the two have in common, minus where one of them is the sign plane. All of
it is integer arithmetic, so distances, ties and means are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statelake.llm.common import named, stored

WIDTH = 64
#: Components must lie in [-LIMIT, LIMIT), so that every squared distance fits a signed 64-bit number.
LIMIT = 1 << 27
#: Vectors whose planes meet those of the centroids at a time.
BLOCK = 2048


def planes_of(values: np.ndarray) -> np.ndarray:
    """Planes of integer vectors (rows of 64): as many words per row as the widest component needs, the last the sign."""
    values = np.asarray(values, np.int64).reshape(-1, WIDTH)
    widest = int(np.maximum(values, ~values).max(initial=0)).bit_length() + 1
    out = np.empty((len(values), widest), np.uint64)
    for i in range(widest):
        bits = ((values >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def weights(planes: int) -> list[int]:
    """What a bit of each plane counts: powers of two, the sign plane negative."""
    return [-(1 << i) if i == planes - 1 else 1 << i for i in range(planes)]


def values_of(planes: np.ndarray) -> np.ndarray:
    """Components of vectors given by planes."""
    bits = np.unpackbits(np.ascontiguousarray(planes, "<u8").view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.tensordot(bits.astype(np.int64), np.array(weights(planes.shape[1]), np.int64), axes=([1], [0]))


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of every vector on the left with every one on the right, by weighted popcounts of common bits."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, a in enumerate(weights(left.shape[1])):
        inner = np.zeros_like(out)
        for j, b in enumerate(weights(right.shape[1])):
            inner += np.int64(b) * np.bitwise_count(left[:, i, None] & right[None, :, j])
        out += np.int64(a) * inner
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Squared length of every vector."""
    w = weights(planes.shape[1])
    out = np.zeros(len(planes), np.int64)
    for i, a in enumerate(w):
        for j, b in enumerate(w):
            out += np.int64(a * b) * np.bitwise_count(planes[:, i] & planes[:, j])
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and squared distance, for vectors and centroids as planes."""
    to = squares(centroids)
    cluster, distance = np.empty(len(planes), np.int64), np.empty(len(planes), np.int64)
    for low in range(0, len(planes), BLOCK):
        part = planes[low:low + BLOCK]
        far = squares(part)[:, None] + to[None, :] - 2 * dots(part, centroids)
        at = far.argmin(1)
        cluster[low:low + BLOCK], distance[low:low + BLOCK] = at, far[np.arange(len(part)), at]
    return cluster, distance


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """`vec_id`, `q`: floor(scale * x) of every component, x as double; only vectors of 64 finite components stay."""
    vec = named(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    kept = vectors.filter((F.size(vec) == WIDTH) & finite).select(
        named(id_col).cast("long").alias("vec_id"), scaled.alias("q")
    )
    wide = F.exists("q", lambda x: (x >= LIMIT) | (x < -LIMIT))
    return kept.withColumn("q", F.when(
        wide, F.raise_error(F.lit(f"a component is beyond {LIMIT}: squared distances do not fit 64 bits"))
    ).otherwise(F.col("q")))


def _packed(vectors: DataFrame) -> DataFrame:
    """`vec_id`, `planes`: the words of the planes one after the other, 8 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("q").flatten().to_numpy(zero_copy_only=False)
            planes = planes_of(values)
            size = 8 * planes.shape[1]
            data = pa.py_buffer(planes.astype("<u8").tobytes())
            ends = pa.py_buffer(np.arange(0, size * len(planes) + 1, size, dtype=np.int32).tobytes())
            words = pa.Array.from_buffers(pa.binary(), len(planes), [None, ends, data])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), words], names=["vec_id", "planes"])

    return vectors.mapInArrow(run, "vec_id long, planes binary")


def _unpacked(column: pa.Array) -> np.ndarray:
    """Planes of a batch; vectors with fewer planes get more copies of their sign plane, which changes no value."""
    words = [np.frombuffer(b, "<u8") for b in column.to_pylist()]
    out = np.empty((len(words), max(map(len, words), default=1)), np.uint64)
    for k, w in enumerate(words):
        out[k, :len(w)], out[k, len(w):] = w, w[-1]
    return out


def _sums(packed: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid; tasks send sums, not vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = planes_of(np.array(centroids, np.int64)), len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                planes = _unpacked(batch.slice(low, BLOCK).column("planes"))
                cluster, _ = nearest(planes, own)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                total[found] += np.add.reduceat(values_of(planes)[order], first, axis=0)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, WIDTH).astype(np.int32)), pa.array(np.tile(np.arange(WIDTH, dtype=np.int32), len(some))),
             pa.array(np.repeat(count[some], WIDTH)), pa.array(total[some].ravel())],
            names=["cluster", "component", "n", "total"],
        )

    rows = packed.select("planes").mapInArrow(run, "cluster int, component int, n long, total long")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in rows.groupBy("cluster", "component").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    ).collect():  # one row per centroid and component
        out.setdefault(row["cluster"], (row["n"], [0] * WIDTH))[1][row["component"]] = int(row["total"])
    return out


def _assigned(packed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = planes_of(np.array(centroids, np.int64))
        for batch in batches:
            cluster, distance = nearest(_unpacked(batch.column("planes")), own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, scale: int = 256,
    salt: str = "2:",
) -> tuple[DataFrame, list[list[int]]]:
    """`vec_id`, `cluster`, `distance` (squared) of every kept vector, and the final centroids.

    Kept are vectors of exactly 64 components, none null or non-finite, as integers floor(scale * x). The first centroids
    are the `k` vectors with the smallest sha256 of salt and id (rows of one id in the order of their components); rows
    with a null id never start a centroid. Fewer vectors than `k`: as many centroids as there are such vectors, and
    none: no rows. Each round takes the exact floor of the means; empty centroids stay. Repeated rows count as often as
    they stand there. A component beyond 2^27 stops the job, as its squared distances need more than 64 bits.

    The planes are written once to the shared scratch folder; a round reads them and sends k * 64 sums per task. The
    driver holds centroids only.
    """
    kept = integer_vectors(vectors, id_col, vec_col, scale)
    draw = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["q"]) for r in kept.filter("vec_id is not null").select(draw.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    packed = stored(_packed(kept), "planes")
    for _ in range(rounds):
        for number, (n, total) in _sums(packed, centroids).items():
            centroids[number] = [t // n for t in total]
    return stored(_assigned(packed, centroids), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """`assigned` and `cluster_inertia`, `inertia`, `centroid_sha256` (of the components as decimals, joined by `,`)."""
    import hashlib

    if not centroids:
        return assigned.withColumns({
            "cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit(""),
        })
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.lit([sums.get(c, 0) for c in range(len(centroids))]).cast("array<long>")
    return assigned.withColumns({
        "cluster_inertia": F.get(own, F.col("cluster")), "inertia": F.lit(sum(sums.values())).cast("long"),
        "centroid_sha256": F.get(F.lit(names), F.col("cluster")),
    })
