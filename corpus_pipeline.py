"""A corpus pipeline of five of the operators: quality, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All stages but the last return the columns of `docs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from statelake.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from statelake.llm.common import fresh, named, stored
from statelake.llm.fitting import fold
from statelake.llm.queries import rank_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that go to a Python worker at a time. An executor holds a batch several times, and an idle worker keeps much of what
#: its largest batch took while the stages without Python run.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows at most for Python, from here on in this session: a stage runs after it has returned."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:  # 0 and less: no bound
        spark.conf.set(setting, str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; labels of every fifth id take no part in the training."""
    small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return docs.filter(model.score(F.col("text")) >= 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds; `n_chars` follows the text."""
    lines, dropped, kept = fresh(docs, "n_lines", "n_dropped", "kept_text")
    out = line_dedup.dedup_lines(docs, out=(lines, dropped, kept))
    changes = {"text": named(kept), "n_chars": F.length(named(kept)).cast(docs.schema["n_chars"].dataType)} if (
        "n_chars" in docs.columns
    ) else {"text": named(kept)}
    return out.select(*[changes[c].alias(c) if c in changes else named(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digests of ids and of the decoded bytes."""
    small_batches(spark)
    path, pattern = rank_file()
    return bpe.encode_column(docs, path, pattern)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

#: SQL can neither train nor apply the classifier and has no tokenizer; tests hold `run` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
