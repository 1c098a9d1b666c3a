"""Ad-hoc SQL over the registered views."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from statelake.sinks.tables import QueryResult, result_of


class QueryError(ValueError):
    """A query text that cannot be run, with a readable reason."""


def sql(spark: SparkSession, text: str) -> DataFrame:
    """The query as a DataFrame; blanks and a semicolon at the end do not matter."""
    body = (text or "").strip().rstrip(";").strip()
    if not body:
        raise QueryError("empty SQL")
    try:
        return spark.sql(body)
    except PySparkException as error:
        raise QueryError(f"query failed: {error}") from error


def run_sql(spark: SparkSession, text: str, limit: int | None) -> QueryResult:
    """Run a query for display: at most `limit` rows, or with None all of them. `sql` gives rows that stay in Spark."""
    df = sql(spark, text)
    try:
        return result_of(df, limit)
    except PySparkException as error:
        raise QueryError(f"query failed: {error}") from error
