"""How a query and its oracle are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def s6(sql: str) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round(({sql})::DOUBLE, 6) + 0.0)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


#: The landmark view: 11 points of each vector; ``second`` is another configuration of the same ids.
LM = """lm AS (SELECT vec_id AS id, label, k::INT AS canonical_id, embedding[2 * k - 1]::DOUBLE AS x, embedding[2 * k]::DOUBLE AS y
  FROM embeddings, range(1, 12) t(k)),
second AS (SELECT vec_id AS id, label, k::INT AS canonical_id, embedding[22 + 2 * k - 1]::DOUBLE AS x, embedding[22 + 2 * k]::DOUBLE AS y
  FROM embeddings, range(1, 12) t(k))"""


def points_of(column: str, offset: int = 0) -> Column:
    """Landmarks packed from a vector column, without a shuffle."""
    e = F.col(column)
    return F.transform(
        F.sequence(F.lit(1), F.lit(11)),
        lambda k: F.struct(
            k.alias("canonical_id"),
            F.get(e, 2 * k - 2 + offset).cast("double").alias("x"),
            F.get(e, 2 * k - 1 + offset).cast("double").alias("y"),
        ),
    )


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, points, second``: one row for each entity."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", points_of("embedding").alias("points"), points_of("embedding", 22).alias("second"))


def long_points(spark: SparkSession, sf_dir: str, which: str = "points") -> DataFrame:
    """``id, label, canonical_id, x, y``: one row for each point."""
    return packed(spark, sf_dir).select("id", "label", F.inline(which))
