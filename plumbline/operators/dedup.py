"""Exact and near duplicates of records, repeated annotations, and quarantines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def content_id(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE2b of 8 bytes, in hex; the one digest that Spark has no function for."""
    for s in parts:
        yield s.map(lambda v: None if v is None else hashlib.blake2b(v.encode() if isinstance(v, str) else bytes(v), digest_size=8).hexdigest())


def exact_groups(records: DataFrame, digest: str, nulls: bool = False) -> DataFrame:
    """``duplicate_group_id, digest, group_size`` of digests that occur twice or more, numbered in digest order.

    With ``nulls`` missing digests are a group too, the last one.  Numbers have four digits or more.

    Numbers come from a count of smaller digests by range, so no sort meets in one task:
    digests are ranked inside buckets of their leading characters, and the buckets' sizes add up.
    """
    known = records if nulls else records.filter(F.col(digest).isNotNull())
    sizes = known.groupBy(digest).agg(F.count("*").alias("group_size")).filter("group_size > 1")
    sizes = sizes.withColumn("_bucket", F.coalesce(F.substring(digest, 1, 2), F.lit("\U0010ffff")))  # nulls come last
    per = sizes.groupBy("_bucket").agg(F.count("*").alias("_n"))  # at most 257 rows for hex digests
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(digest))
    out = sizes.withColumn("_r", rank).join(per.select("_bucket", before.alias("_before")), "_bucket")
    return out.select(F.format_string("exact_%04d", F.col("_r") + F.col("_before")).alias("duplicate_group_id"), digest, "group_size")


def membership(records: DataFrame, digest: str) -> DataFrame:
    """``records`` with ``duplicate_group_id`` (null alone) and ``is_exact_duplicate_member``."""
    out = records.join(exact_groups(records, digest).select(digest, "duplicate_group_id"), digest, "left")
    return out.withColumn("is_exact_duplicate_member", F.col("duplicate_group_id").isNotNull())


def conflicting_labels(records: DataFrame, digest: str, label: str, reason: str) -> DataFrame:
    """Every record whose digest carries more than one label."""
    bad = records.groupBy(digest).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a <> _b").select(digest)
    return records.join(bad, digest, "left_semi").withColumn("exclusion_reason", F.lit(reason))


def consolidated(c: str) -> Column:
    """The one value of a group, or ``conflicted``; an aggregate."""
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise("conflicted")


def piped(c: str) -> Column:
    """Distinct values, sorted and joined by pipes; an aggregate."""
    return F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")


def gradient_bits(v: Column, n: int) -> Column:
    """n - 1 bits of a vector of n elements, most significant first: whether the next element is larger."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: (F.get(v, i + 1) > F.get(v, i)).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


#: Bits of a band below which banding wouldn't narrow a block.
LEAST_BAND_BITS = 8


def near_pairs(
    records: DataFrame, block: list[str], key: str, bits: str, most: int, width: int = 64, size: str | None = None, content: str | None = None, ratio: float = 0.01
) -> DataFrame:
    """Pairs of a block within a Hamming distance: ``left_id, right_id, hamming_distance``, left < right.

    The bits are cut into ``most + 1`` bands; a pair within the distance agrees on one of
    them, so bands are join keys wherever they are wide enough to be worth it.  With ``size``
    the sizes differ by at most ``ratio`` of the larger one, which is given as
    ``relative_file_size_difference``; with ``content`` equal contents are no pair.  A null
    in a column that is compared makes no pair.
    """
    n = most + 1
    more = [c for c in (size, content) if c]
    cols = [*block, key, bits, *more]
    if width // n >= LEAST_BAND_BITS:
        part = -(-width // n)
        bands = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(bits, k * part).bitwiseAND(F.lit((1 << part) - 1)).alias("v")) for k in range(n)])
        dealt, on = records.select(*cols, F.explode(bands).alias("_band")), [*block, "_band"]
    else:
        dealt, on = records.select(*cols), block
    a, b = (dealt.select(*on, F.col(key).alias(f"{s}_id"), F.col(bits).alias(f"_{s}"), *[F.col(c).alias(f"_{s}_{c}") for c in more]) for s in ("left", "right"))
    distance = F.bit_count(F.col("_left").bitwiseXOR(F.col("_right"))).cast("int")
    pairs = a.join(b, on).filter("left_id < right_id").withColumn("hamming_distance", distance).filter(F.col("hamming_distance") <= most)
    out = [*block, "left_id", "right_id", "hamming_distance"]
    if content:
        pairs = pairs.filter(F.col(f"_left_{content}") != F.col(f"_right_{content}"))
    if size:
        left, right = F.col(f"_left_{size}").cast("double"), F.col(f"_right_{size}").cast("double")
        pairs = pairs.withColumn("relative_file_size_difference", F.try_divide(F.abs(left - right), F.greatest(left, right)))
        pairs, out = pairs.filter(F.col("relative_file_size_difference") <= ratio), [*out, "relative_file_size_difference"]
    pairs = pairs.select(*out)
    return pairs.distinct() if "_band" in on else pairs


def repeat_disagreement(points: DataFrame, group: str, record: str, point: str, diagonal: Column, complete: int = 11) -> DataFrame:
    """Disagreement of the records of each group: means over pairs of each pair's mean distance.

    ``points``: group, record, point, x, y and what ``diagonal`` needs.
    """
    p = points.withColumn("_diag", diagonal)
    a = p.select(group, point, F.col(record).alias("_l"), F.col("x").alias("_lx"), F.col("y").alias("_ly"), "_diag")
    b = p.select(group, point, F.col(record).alias("_r"), F.col("x").alias("_rx"), F.col("y").alias("_ry"))
    gap = F.hypot(F.col("_lx") - F.col("_rx"), F.col("_ly") - F.col("_ry"))
    pairs = a.join(b, [group, point]).filter("_l < _r").groupBy(group, "_l", "_r").agg(
        F.avg(gap).alias("_mean"), F.max(gap).alias("_max"), F.count("*").alias("_n"), F.min("_diag").alias("_diag")
    )
    share = F.when(F.col("_diag") > 0, F.col("_mean") / F.col("_diag"))
    return pairs.groupBy(group).agg(
        F.count("*").alias("pair_count"),
        F.count(F.when(F.col("_n") == complete, 1)).alias("complete_pair_count"),
        F.avg("_mean").alias("pairwise_mean_error"),
        F.max("_max").alias("pairwise_max_error"),
        F.avg(share).alias("pairwise_mean_error_diagonal"),
    )


def quarantine(pairs: DataFrame, roles: DataFrame, held: str = "test") -> DataFrame:
    """Pairs across partitions with the member to quarantine.

    ``pairs``: left_id, right_id; ``roles``: id, role.  Ids without a role are outside the
    protocol.  Where one side is held out and the other is used, the held-out side goes.
    """
    side = lambda s: roles.select(F.col("id").alias(f"{s}_id"), F.col("role").alias(f"{s}_role"))
    out = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    out = out.fillna({"left_role": "not_in_protocol", "right_role": "not_in_protocol"})
    used = lambda s: F.col(s).isin("train", "validation")
    goes = F.when((F.col("left_role") == held) & used("right_role"), F.col("left_id")).when((F.col("right_role") == held) & used("left_role"), F.col("right_id"))
    return out.withColumn("quarantine_id", goes)
