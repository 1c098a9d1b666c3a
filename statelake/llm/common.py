"""What several operators share: fresh column names, scratch tables, plain text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from statelake.session import scratch_path

#: The characters stripped at the ends of a line key, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LAST_ID = (1 << 63) - 1


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of `df`, whatever it brings along."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(named(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts without other letters take the quick way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def two_hashes(value: Column) -> tuple[Column, Column]:
    """128 bits in two longs: the second hash is seeded by another value."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared scratch folder and read back: the plan is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, name: str, *numbers: Column) -> tuple[DataFrame, tuple]:
    """As `stored`, and aggregates of the rows, taken while they are written."""
    seen = Observation()
    labels = [f"n{k}" for k in range(len(numbers))]
    out = stored(df.observe(seen, *[n.alias(label) for n, label in zip(numbers, labels)]), name)
    return out, tuple(seen.get.get(label) for label in labels)
