import random

import pytest
from pyspark.sql import types as T

ROOT = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the table.
CLASHING = ("node", "class", "h1", "h2", "gone", "doc", "text_hash", "lines", "merged", "range", "cum", "row", "tie",
            "score", "label", "role", "id", "kept", "bands", "b", "w", "x", "part", "recipe", "r", "shard", "n_lines")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "漢字", "eps-1", "zeta.", "Ünter", "the", "of"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    some = "The first line is long enough\nshort\n  THE FIRST line is long enough \n\nlast one here, really"
    pairs = [
        (1, some), (2, None), (3, ""), (4, some), (5, some.upper()), (6, long), (7, long + "."), (8, "a" * 5000),
        (9, "\n\n\n"), (10, "short"), (10, "short"), (11, some), (11, "other text\nThe first line is long enough"),
        (None, some), (None, None), (None, "only here and nowhere else, is it"), (12, "x\ty z  \r\nThe first line is long enough"),
        (0, "\x0b The FIRST Line is long ENOUGH\x0c"), (-5, "é" * 12 + "\nÉ" * 3 + "\n" + "É" * 12), (13, "😀 ok\n" * 40),
    ]
    return [(i, t, None if k % 3 else "en", *[f"v{k}"] * len(CLASHING)) for k, (i, t) in enumerate(pairs)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def pairs():
    """(doc_id, text) of the awkward table."""
    return [r[:2] for r in awkward_rows()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
