"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, shortens a text more.

The dictionaries are built from labelled texts of either kind. The difference of the two compressed sizes, divided by the
size of the text, is the evidence; a logistic fit on labelled texts that no dictionary has seen turns it, with the
compressed size itself and the length, into a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from statelake.llm.fitting import Logistic, labelled_sample

#: Bounds of the sample: texts per label for the dictionaries and for the calibration; a text for the dictionaries is cut
#: into pieces over its whole length, of which so many, drawn by a hash, are trained on; few, so that no text outweighs others.
DICTIONARY_TEXTS, CALIBRATION_TEXTS = 1000, 2000
PIECE_BYTES, PIECES = 4096, 2
DICTIONARY_BYTES, LEVEL = 112 << 10, 3


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too few samples to train on serve as they are."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text under each of two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data) if data else None
            if held is not None:
                held.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)
            )

    def features(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "replace")
        good, bad = (len(c.compress(raw)) for c in self.compressors)
        size = len(raw) + 64
        gain, packed, length = (bad - good) / size, np.log((good + 8) / size), np.log(size)
        return [gain, packed, packed * packed, length, gain * length, gain * packed, (bad - good) / (bad + good + 1)]


def drawn_pieces(number: str, text: str) -> Column:
    """PIECES pieces of PIECE_BYTES of a text that is not empty, those with the least hash wherever they stand, in order."""
    raw = F.col(text).cast("binary")
    cuts = F.sequence(F.lit(0), F.floor((F.octet_length(text) - 1) / PIECE_BYTES).cast("int"))
    ranked = F.array_sort(F.transform(cuts, lambda k: F.struct(F.xxhash64(F.lit(13), number, k).alias("h"), k.alias("k"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, PIECES), lambda p: p["k"]))
    return F.transform(chosen, lambda k: F.substring(raw, k * PIECE_BYTES + 1, F.lit(PIECE_BYTES)))


class QualityModel:
    """Dictionaries and calibration; `score` is a column expression. Small (two dictionaries), sent to tasks by Spark."""

    def __init__(self, good: bytes, bad: bytes, fit: Logistic):
        self.good, self.bad, self.fit = good, bad, fit

    def score(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sizes = Sizes(model.good, model.bad)
            for part in parts:
                x = np.array([sizes.features(t) for t in part], float).reshape(len(part), 7)
                yield pd.Series(model.fit(x))

        return scored(F.coalesce(text.cast("string"), F.lit("")))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from the rows of `labels` (id, quality) for which `usable` holds.

    Whole texts are compressed, empty ones included. Without labelled rows of both kinds the score still exists: it is
    near 0.5, or near the only label there is.
    """
    sample, counts = labelled_sample(
        docs, labels, "quality", usable,
        {"dictionary": {0: DICTIONARY_TEXTS, 1: DICTIONARY_TEXTS}, "fit": {0: CALIBRATION_TEXTS, 1: CALIBRATION_TEXTS}},
        id_col, text_col,
    )
    sample = sample.persist()
    try:
        texts = sample.filter("role = 'dictionary' and text <> ''").select("id", "label", drawn_pieces("id", "text").alias("pieces")).collect()
        texts.sort(key=lambda r: r["id"])
        good, bad = (dictionary([b"".join(map(bytes, r["pieces"])) for r in texts if r["label"] == v]) for v in (1, 0))

        @F.pandas_udf("array<double>")
        def features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sizes = Sizes(good, bad)
            for part in parts:
                yield pd.Series([sizes.features(t) for t in part])

        rows = sample.filter("role = 'fit'").select("label", features("text").alias("x")).collect()
    finally:
        sample.unpersist()
    y = np.array([r["label"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), 7)
    # the classes are sampled alike; weights bring back their shares
    weight = np.ones(len(y))
    for value in (0, 1):
        mine = y == value
        if mine.any():
            weight[mine] = counts[value] / mine.sum()
    return QualityModel(good, bad, Logistic(x, y, weight * len(y) / max(1e-9, weight.sum()), ridge=0.1))


def with_score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of every whole text: 0 to 1, higher is better; null counts as empty.

    `out` takes the place of a column of that name.
    """
    return docs.withColumn(out, model.score(F.col("`" + text_col.replace("`", "``") + "`")))
