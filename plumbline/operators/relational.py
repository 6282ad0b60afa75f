"""Relational helpers with contracts that plain joins and unions lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, minimum, quartiles (linear interpolation) and maximum by group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi"))
    named = {"minimum": F.col("lo"), "q1": F.get("q", F.lit(0)), "median": F.get("q", F.lit(1)), "q3": F.get("q", F.lit(2)), "maximum": F.col("hi")}
    return g.select(*by, "n", *[F.round(c.cast("double"), 6).alias(k) for k, c in named.items()])


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """``stage, n, excluded_from_previous`` from one pass over the rows."""
    one = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in stages.items()])
    names = list(stages)
    rows = [
        F.struct(F.lit(k).alias("stage"), F.col(k).alias("n"), (F.col(names[i - 1]) - F.col(k) if i else F.lit(0).cast("long")).alias("excluded_from_previous"))
        for i, k in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on ``key`` that raises if a key occurs twice on the right.

    Uniqueness is checked where the right side is grouped by its key, not in a job of its own.
    """
    rest = [c for c in right.columns if c != key]
    g = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    checked = g.select(key, *[F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate keys in {key}")).cast(right.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in rest])
    return left.join(checked, key, "left")


def replace_partition(old: DataFrame, new: DataFrame, partition: Column) -> DataFrame:
    """``old`` without the partition's rows, and ``new``."""
    return old.filter(~F.coalesce(partition, F.lit(False))).unionByName(new)


def ordered_lookup(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of ``df`` for a list of ids that the caller wrote down, with ``pos`` in the list; raises for an unknown id."""
    kind = df.schema[key].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, `{key}` {kind}")
    found = df.filter(F.col(key).isin(ids)).withColumn("_found", F.lit(True))
    j = wanted.join(found, key, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown id: "), F.col(key).cast("string"))).cast("int")
    j = j.withColumn("pos", F.when(F.col("_found").isNull(), unknown).otherwise(F.col("pos")))
    return j.select("pos", *df.columns).orderBy("pos")


def first_match(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds; null without one."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in rules.items()])


def last_match(rules: dict[str, Column], default: str) -> Column:
    """The name of the last rule that holds, for chains of overwrites."""
    return F.coalesce(*[F.when(c, F.lit(k)) for k, c in reversed(rules.items())], F.lit(default))
