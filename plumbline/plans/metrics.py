"""Prediction metrics, agreement, resampling and model comparison on the carrier tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import stats
from plumbline.plans.base import LM, long_points, packed, query, r6, s6, table

THRESHOLDS = {"pck_0_02": 0.02, "pck_0_05": 0.05, "pck_0_10": 0.10}

#: Every 17th id has no prediction.
_METRIC = f"""{LM}, lens AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM lm a JOIN lm b USING (id) WHERE a.canonical_id = 1 AND b.canonical_id = 6),
er AS (SELECT lm.id, lm.label, canonical_id, lm.x AS tx, lm.y AS ty, CASE WHEN lm.id % 17 <> 0 THEN s.x END AS px, CASE WHEN lm.id % 17 <> 0 THEN s.y END AS py, len FROM lm JOIN second s USING (id, canonical_id) JOIN lens USING (id)),
e2 AS (SELECT *, sqrt((px - tx) ** 2 + (py - ty) ** 2) AS e, sqrt((px - tx) ** 2 + (py - ty) ** 2) / greatest(len, 1e-12) AS ne FROM er),
sm AS (SELECT id, label, max(len) AS len, avg(e) AS mean_error, sqrt(avg(e * e)) AS rmse, avg(ne) AS nme,
  {", ".join(f"avg((coalesce(ne, 1e9) <= {t})::INT::DOUBLE) AS {n}" for n, t in THRESHOLDS.items())},
  sum(px * px + py * py) - (sum(px) ** 2 + sum(py) ** 2) / 11 AS pp, sum(tx * tx + ty * ty) - (sum(tx) ** 2 + sum(ty) ** 2) / 11 AS tt,
  sum(px * tx + py * ty) - (sum(px) * sum(tx) + sum(py) * sum(ty)) / 11 AS a, sum(px * ty - py * tx) - (sum(px) * sum(ty) - sum(py) * sum(tx)) / 11 AS b
  FROM e2 GROUP BY id, label),
im AS (SELECT *, id % 17 <> 0 AS detected, CASE WHEN pp IS NOT NULL THEN sqrt(greatest(2 - 2 * sqrt(a * a + b * b) / sqrt(pp * tt), 0) / 11) END AS procrustes FROM sm)"""


def image_metrics(df: DataFrame) -> DataFrame:
    """``df(id, label, points, second)``: metrics of ``second`` as a prediction of ``points``; null where it is missing.

    A missing prediction has no errors, but counts as wrong at every threshold.
    """
    df = df.select(
        "id", "label", "points", "second", G.chord(F.col("points"), 1, 6).alias("len"),
        F.zip_with("second", "points", G.distance).alias("e"), G.centred(F.col("second")).alias("pc"), G.centred(F.col("points")).alias("tc"),
    )
    df = df.withColumn("ne", F.transform("e", lambda v: v / F.greatest(F.col("len"), F.lit(G.TINY)))).withColumn("terms", G.procrustes_terms(F.col("pc"), F.col("tc")))
    n = F.size("points")
    mean = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, v: s + f(v)) / n
    hits = {k: F.coalesce(mean("ne", lambda v, t=t: F.when(v <= t, 1.0).otherwise(0.0)), F.lit(0.0)).alias(k) for k, t in THRESHOLDS.items()}
    return df.select(
        "id", "label", F.col("second").isNotNull().alias("detected"), "len", mean("e", lambda v: v).alias("mean_error"), F.sqrt(mean("e", lambda v: v * v)).alias("rmse"),
        mean("ne", lambda v: v).alias("nme"), *hits.values(), G.procrustes_rmse(F.col("terms"), n).alias("procrustes"), "e", "ne", "points", "second",
    )


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return image_metrics(packed(spark, sf).withColumn("second", F.when(F.col("id") % 17 != 0, F.col("second"))))


_NAMES = ("mean_error", "rmse", "nme", "pck_0_02", "pck_0_05", "pck_0_10", "procrustes")


@query(f"WITH {_METRIC} SELECT id, detected, {s6('len')} AS body_length, " + ", ".join(f"{s6(n)} AS {n}" for n in _NAMES) + " FROM im")
def per_image_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("id", "detected", r6(F.col("len")).alias("body_length"), *[r6(F.col(n)).alias(n) for n in _NAMES])


@query(
    f"WITH {_METRIC}, ch AS (SELECT u.id, u.canonical_id AS a, v.canonical_id AS b, sqrt((u.px - v.px) ** 2 + (u.py - v.py) ** 2) AS p, sqrt((u.tx - v.tx) ** 2 + (u.ty - v.ty) ** 2) AS t FROM e2 u JOIN e2 v USING (id)) SELECT id, chord, "
    f"{s6('abs(p - t)')} AS absolute_error, {s6('abs(p - t) / greatest(t, 1e-12)')} AS relative_error FROM ch JOIN (VALUES "
    + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in G.CHORDS.items())
    + ") c(chord, a, b) USING (a, b) WHERE p IS NOT NULL"
)
def chord_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute and relative chord errors, one row for each chord of each detected image."""

    def row(n: str, a: int, b: int) -> Column:
        t, p = G.chord(F.col("points"), a, b), G.chord(F.col("second"), a, b)
        return F.struct(F.lit(n).alias("chord"), r6(F.abs(p - t)).alias("absolute_error"), r6(F.abs(p - t) / F.greatest(t, F.lit(G.TINY))).alias("relative_error"))

    df = packed(spark, sf).filter("id % 17 <> 0")
    return df.select("id", F.inline(F.array(*[row(n, a, b) for n, (a, b) in G.CHORDS.items()])))


@query(
    f"WITH {_METRIC}, l AS (UNPIVOT (SELECT id, label, detected, {', '.join(_NAMES)} FROM im) ON {', '.join(_NAMES)} INTO NAME metric VALUE v) "
    f"SELECT scope, metric, count(v)::BIGINT AS n, {s6('avg(v)')} AS mean FROM (SELECT 'overall' AS scope, metric, v FROM l WHERE detected UNION ALL SELECT 'group:' || label, metric, v FROM l WHERE detected "
    "UNION ALL SELECT 'all_images', metric, v FROM l WHERE metric LIKE 'pck%') GROUP BY scope, metric"
)
def metric_summary_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means by scope and metric from one long table, so one shuffle serves all scopes."""
    long = _images(spark, sf).select("id", "label", "detected", *_NAMES).unpivot(["id", "label", "detected"], list(_NAMES), "metric", "v")
    group = F.concat(F.lit("group:"), F.col("label").cast("string"))
    scopes = F.array_compact(F.array(F.when(F.col("detected"), F.lit("overall")), F.when(F.col("detected"), group), F.when(F.col("metric").startswith("pck"), F.lit("all_images"))))
    return long.filter("v is not null").select(F.explode(scopes).alias("scope"), "metric", "v").groupBy("scope", "metric").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"))


@query(f"WITH {_METRIC} SELECT canonical_id, count(ne)::BIGINT AS n, {s6('avg(ne)')} AS mean_nme, {s6('quantile_cont(ne, 0.5)')} AS median_nme FROM e2 WHERE ne IS NOT NULL GROUP BY canonical_id")
def per_keypoint_means(spark: SparkSession, sf: str) -> DataFrame:
    long = _images(spark, sf).filter("detected").select(F.posexplode("ne").alias("k", "v"))
    return long.groupBy((F.col("k") + 1).alias("canonical_id")).agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean_nme"), r6(F.percentile("v", F.lit(0.5))).alias("median_nme"))


@query(
    f"WITH {LM}, nx AS (SELECT *, label + 0 AS g FROM lm), st AS (SELECT a.id AS l, b.id AS r, sum(a.x * a.x + a.y * a.y) - (sum(a.x) ** 2 + sum(a.y) ** 2) / 11 AS pp, sum(b.x * b.x + b.y * b.y) - (sum(b.x) ** 2 + sum(b.y) ** 2) / 11 AS tt, "
    "sum(a.x * b.x + a.y * b.y) - (sum(a.x) * sum(b.x) + sum(a.y) * sum(b.y)) / 11 AS p, sum(a.x * b.y - a.y * b.x) - (sum(a.x) * sum(b.y) - sum(a.y) * sum(b.x)) / 11 AS q "
    f"FROM lm a JOIN lm b ON a.id // 4 = b.id // 4 AND a.canonical_id = b.canonical_id AND a.id < b.id GROUP BY ALL) SELECT l AS left_id, r AS right_id, {s6('sqrt(greatest(2 - 2 * sqrt(p * p + q * q) / sqrt(pp * tt), 0) / 11)')} AS procrustes FROM st"
)
def procrustes_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs inside groups of four neighbouring ids."""
    df = packed(spark, sf).select(F.floor(F.col("id") / 4).alias("grp"), "id", G.centred(F.col("points")).alias("c"))
    a, b = (df.select("grp", F.col("id").alias(f"{s}_id"), F.col("c").alias(f"{s}_c")) for s in ("left", "right"))
    pairs = a.join(b, "grp").filter("left_id < right_id").withColumn("t", G.procrustes_terms(F.col("left_c"), F.col("right_c")))
    return pairs.select("left_id", "right_id", r6(G.procrustes_rmse(F.col("t"), F.lit(11))).alias("procrustes"))


@query(
    f"WITH {LM}, pr AS (SELECT lm.canonical_id, lm.x AS a, s.x AS b FROM lm JOIN second s USING (id, canonical_id)), "
    "g AS (SELECT canonical_id, count(*) AS n, var_samp(a + b) / 2 AS msr, var_samp(a - b) / 2 AS mse, count(*) * (avg(a) - avg(b)) ** 2 / 2 AS msc FROM pr GROUP BY canonical_id) "
    f"SELECT canonical_id, n::BIGINT AS n, {s6('(msr - mse) / (msr + mse + 2 * (msc - mse) / n)')} AS icc FROM g"
)
def icc_by_point(spark: SparkSession, sf: str) -> DataFrame:
    p = packed(spark, sf).select(F.inline(F.zip_with("points", "second", lambda a, b: F.struct(a["canonical_id"].alias("canonical_id"), a["x"].alias("a"), b["x"].alias("b")))))
    return stats.icc_a1("a", "b", "canonical_id")(p).withColumn("icc", r6(F.col("icc")))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")


@query()
def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bootstrap(_events(spark, sf), ["event_type"], "value", "event_id")


@query(f"SELECT event_type, count(value)::BIGINT AS n, {s6('avg(value)')} AS mean FROM events WHERE isfinite(value) GROUP BY event_type")
def bootstrap_mean_point(spark: SparkSession, sf: str) -> DataFrame:
    """What of :func:`bootstrap_mean_ci` doesn't depend on a generator."""
    return _events(spark, sf).filter(stats.finite(F.col("value"))).groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"))


@query()
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the paired difference in mean error between two predictions of the same ids."""
    p = packed(spark, sf).withColumn("third", F.transform("second", lambda q: F.struct((q["x"] * 0.9).alias("x"), (q["y"] * 0.9).alias("y"))))
    mean = lambda c: F.aggregate(F.zip_with(c, "points", G.distance), F.lit(0.0), lambda s, v: s + v) / 11
    d = p.select("id", F.lit("third_minus_second").alias("comparison"), (mean("third") - mean("second")).alias("d"))
    return stats.bootstrap(d.filter(stats.finite(F.col("d"))), ["comparison"], "d", "id")


@query()
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cluster_bootstrap(_events(spark, sf), ["event_type"], "value", "user_id")


@query(f"SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS clusters, {s6('avg(value)')} AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def cluster_mean_point(spark: SparkSession, sf: str) -> DataFrame:
    """What of :func:`cluster_bootstrap` doesn't depend on a generator."""
    e = _events(spark, sf).filter("value is not null")
    sums = e.groupBy("event_type", "user_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return sums.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), r6(F.sum("s") / F.sum("n")).alias("mean"))


_REPS = 40


@query(
    f"WITH v AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n, avg(value) AS m FROM events WHERE value IS NOT NULL GROUP BY user_id), "
    f"dr AS (SELECT rep, ((v.i * 1103515245 + rep * 12345 + 42) % 2147483647) % v.n AS pick FROM v, range({_REPS}) t(rep)), "
    f"ms AS (SELECT rep, avg(v.m) AS m FROM dr JOIN v ON v.i = dr.pick GROUP BY rep) SELECT count(*)::BIGINT AS replicates, {s6('quantile_cont(m, 0.025)')} AS ci95_low, {s6('quantile_cont(m, 0.975)')} AS ci95_high FROM ms"
)
def lcg_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """A bootstrap over users whose draws follow a congruential rule; a variant, not the generator above."""
    from pyspark.sql import Window

    users = _events(spark, sf).filter("value is not null").groupBy("user_id").agg(F.avg("value").alias("m"))
    users = users.withColumn("i", F.row_number().over(Window.orderBy("user_id")).cast("long") - 1)
    n = users.agg(F.count("*").alias("n"))
    draws = users.select("i").join(F.broadcast(n)).select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(_REPS - 1))).alias("rep"))  # one row is broadcast
    picks = draws.select("rep", stats.lcg_index(F.col("i"), F.col("rep").cast("long"), F.col("n")).alias("i"))
    means = picks.join(users.select("i", "m"), "i").groupBy("rep").agg(F.avg("m").alias("m"))
    return means.agg(F.count("*").alias("replicates"), r6(F.percentile("m", F.lit(0.025))).alias("ci95_low"), r6(F.percentile("m", F.lit(0.975))).alias("ci95_high"))


_MODELS = f"{LM}, pd AS (SELECT lm.id, avg(sqrt((lm.x - s.x) ** 2 + (lm.y - s.y) ** 2)) AS alpha, avg(sqrt((lm.x - 0.9 * s.x) ** 2 + (lm.y - 0.9 * s.y) ** 2)) AS beta, avg(sqrt((lm.x - 0.5 * s.x) ** 2 + (lm.y - 0.5 * s.y) ** 2)) AS gamma FROM lm JOIN second s USING (id, canonical_id) GROUP BY lm.id)"
_SCALES = {"alpha": 1.0, "beta": 0.9, "gamma": 0.5}


def _models(spark: SparkSession, sf: str) -> DataFrame:
    """``id, alpha, beta, gamma``: mean errors of three predictions."""

    def error(scale: float) -> Column:
        gaps = F.zip_with("points", "second", lambda t, p: F.hypot(t["x"] - scale * p["x"], t["y"] - scale * p["y"]))
        return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / 11

    return packed(spark, sf).select("id", *[error(s).alias(n) for n, s in _SCALES.items()])


@query(f"WITH {_MODELS} SELECT id, {s6('alpha')} AS alpha__mean_error, {s6('beta')} AS beta__mean_error, {s6('gamma')} AS gamma__mean_error, {s6('beta - alpha')} AS beta_minus_alpha, {s6('gamma - alpha')} AS gamma_minus_alpha FROM pd")
def model_comparison_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of several models joined on their ids, one column for each model."""
    m = _models(spark, sf)
    frames = [m.select("id", r6(F.col(n)).alias(f"{n}__mean_error"), F.col(n)) for n in _SCALES]
    j = frames[0].join(frames[1], "id").join(frames[2], "id")
    return j.select("id", *[f"{n}__mean_error" for n in _SCALES], r6(F.col("beta") - F.col("alpha")).alias("beta_minus_alpha"), r6(F.col("gamma") - F.col("alpha")).alias("gamma_minus_alpha"))


@query(f"WITH {_MODELS}, l AS (UNPIVOT pd ON alpha, beta, gamma INTO NAME model VALUE v) SELECT model, count(*)::BIGINT AS n, {s6('avg(v)')} AS mean, {s6('quantile_cont(v, 0.5)')} AS median FROM l GROUP BY model")
def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    long = _models(spark, sf).unpivot("id", list(_SCALES), "model", "v")
    return long.groupBy("model").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.percentile("v", F.lit(0.5))).alias("median"))


@query("SELECT count(*) FILTER (a.c_custkey IS NOT NULL AND b.o_custkey IS NOT NULL)::BIGINT AS common, count(*) FILTER (b.o_custkey IS NULL)::BIGINT AS only_left, count(*) FILTER (a.c_custkey IS NULL)::BIGINT AS only_right FROM customer a FULL JOIN (SELECT DISTINCT o_custkey FROM orders) b ON c_custkey = o_custkey")
def id_alignment_check(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full")
    return j.agg(
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("common"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("a").isNull(), 1)).alias("only_right"),
    )


#: A crosswalk of external names to components (fixed values): tier, components.
_CROSSWALK = {"snout": ("strict", (1,)), "dorsal_mid": ("strict", (3, 4)), "caudal_mid": ("strict", (5, 7)), "belly": ("candidate", (8, 9)), "head": ("candidate", (2, 10))}
_CROSS_SQL = ", ".join(f"('{n}', '{t}', {c}, {len(cs)})" for n, (t, cs) in _CROSSWALK.items() for c in cs)
_CROSS = f"{LM}, cw(name, tier, canonical_id, parts) AS (VALUES {_CROSS_SQL}), mp AS (SELECT lm.id, name, tier, avg(lm.x) AS x, avg(lm.y) AS y, avg(s.x) AS px, avg(s.y) AS py FROM lm JOIN cw USING (canonical_id) JOIN second s USING (id, canonical_id) WHERE lm.x > -0.3 GROUP BY ALL HAVING count(*) = max(parts))"


def _crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    """Midpoints of components; none where a component is flagged bad (x of -0.3 or less here)."""
    rows = [(n, t, c, len(cs)) for n, (t, cs) in _CROSSWALK.items() for c in cs]
    cw = spark.createDataFrame(rows, "name string, tier string, canonical_id int, parts int")
    both = packed(spark, sf).select("id", F.inline(F.zip_with("points", "second", lambda a, b: F.struct(a["canonical_id"].alias("canonical_id"), a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("px"), b["y"].alias("py")))))
    j = both.filter("x > -0.3").join(F.broadcast(cw), "canonical_id")  # eight rows are broadcast
    g = j.groupBy("id", "name", "tier").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("px").alias("px"), F.avg("py").alias("py"), F.count("*").alias("n"), F.max("parts").alias("parts"))
    return g.filter("n = parts").drop("n", "parts")


@query(f"WITH {_CROSS} SELECT id, name, tier, {s6('x')} AS x, {s6('y')} AS y FROM mp")
def crosswalk_midpoint(spark: SparkSession, sf: str) -> DataFrame:
    return _crosswalk(spark, sf).select("id", "name", "tier", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(
    f"WITH {_CROSS}, er AS (SELECT id, tier, sqrt((x - px) ** 2 + (y - py) ** 2) AS e FROM mp), im AS (SELECT id, tier, avg(e) AS nme, avg((e <= 0.1)::INT) AS pck FROM (SELECT id, tier, e FROM er UNION ALL SELECT id, 'all_candidate', e FROM er) GROUP BY id, tier) "
    f"SELECT tier, count(*)::BIGINT AS images, {s6('avg(nme)')} AS nme, {s6('avg(pck)')} AS pck FROM im GROUP BY tier"
)
def tier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    rows = _crosswalk(spark, sf).select("id", F.explode(F.array("tier", F.lit("all_candidate"))).alias("tier"), e.alias("e"))
    im = rows.groupBy("id", "tier").agg(F.avg("e").alias("nme"), F.avg(F.when(F.col("e") <= 0.1, 1.0).otherwise(0.0)).alias("pck"))
    return im.groupBy("tier").agg(F.count("*").alias("images"), r6(F.avg("nme")).alias("nme"), r6(F.avg("pck")).alias("pck"))


@query(
    f"WITH {LM}, pr AS (SELECT a.id AS l, b.id AS r, a.canonical_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 8 AS e FROM lm a JOIN lm b ON a.id // 4 = b.id // 4 AND a.canonical_id = b.canonical_id AND a.id < b.id) "
    f"SELECT l AS left_id, r AS right_id, {s6('avg(e)')} AS diagonal_nme, {s6('max(e)')} AS worst_nme, {s6('avg((e <= 0.02)::INT)')} AS pck_diag_0_02, {s6('avg((e <= 0.05)::INT)')} AS pck_diag_0_05 FROM pr GROUP BY l, r"
)
def repeat_pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    p = long_points(spark, sf).withColumn("grp", F.floor(F.col("id") / 4))
    a = p.select("grp", "canonical_id", F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.select("grp", "canonical_id", F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = a.join(b, ["grp", "canonical_id"]).filter("left_id < right_id").withColumn("e", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) / 8)
    hit = lambda t: r6(F.avg(F.when(F.col("e") <= t, 1.0).otherwise(0.0)))
    return e.groupBy("left_id", "right_id").agg(r6(F.avg("e")).alias("diagonal_nme"), r6(F.max("e")).alias("worst_nme"), hit(0.02).alias("pck_diag_0_02"), hit(0.05).alias("pck_diag_0_05"))


@query(
    "SELECT role, count(*)::BIGINT AS queries, count(*) FILTER (length(text) > 200)::BIGINT AS outputs, count(DISTINCT conv_id)::BIGINT AS clusters, "
    + s6("avg((length(text) > 200)::INT)")
    + " AS output_rate, "
    + s6("avg(length(text)) FILTER (length(text) > 200)")
    + " AS mean_length FROM conversations GROUP BY role"
)
def zero_shot_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Answers count as outputs over 200 characters; conversations are the clusters."""
    out = F.char_length("text") > 200
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("queries"), F.count(F.when(out, 1)).alias("outputs"), F.countDistinct("conv_id").alias("clusters"),
        r6(F.avg(F.when(out, 1.0).when(~out, 0.0))).alias("output_rate"), r6(F.avg(F.when(out, F.char_length("text")))).alias("mean_length"),
    )


@query(f"SELECT event_type, (user_id % 3)::INT AS domain, count(*)::BIGINT AS n, {s6('avg(value)')} AS mean, {s6('min(value)')} AS minimum, {s6('max(value)')} AS maximum FROM events GROUP BY event_type, user_id % 3")
def domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("domain", (F.col("user_id") % 3).cast("int"))
    return e.groupBy("event_type", "domain").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.min("value")).alias("minimum"), r6(F.max("value")).alias("maximum"))


@query(f"WITH st AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type) SELECT event_id, {s6('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END')} AS scaled, {s6('CASE WHEN hi > lo THEN 1 - (value - lo) / (hi - lo) ELSE 0 END')} AS inverted, {s6('CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END')} AS z FROM events JOIN st USING (event_type)")
def minmax_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics by group are aggregated first (with a map-side combine) and joined, so no group is one task's window."""
    e = _events(spark, sf)
    st = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    c, span = F.col, F.col("hi") - F.col("lo")
    scaled = F.when(span > 0, (c("value") - c("lo")) / span)
    return e.join(st, "event_type").select(
        "event_id", r6(F.coalesce(scaled, F.lit(0.0))).alias("scaled"), r6(F.coalesce(1 - scaled, F.lit(0.0))).alias("inverted"),
        r6(F.when(c("sd") > 0, (c("value") - c("m")) / c("sd")).otherwise(0.0)).alias("z"),
    )


_GRID = 40


@query(
    f"WITH st AS (SELECT event_type, count(*) AS n, stddev_samp(value) * power(count(*), -0.2) AS bw, quantile_cont(value, 0.995) AS top FROM events GROUP BY event_type), "
    f"gd AS (SELECT *, k, top * k / {_GRID - 1} AS g FROM st, range({_GRID}) t(k)), kd AS (SELECT event_type, k, min(g) AS g, sum(exp(-0.5 * ((g - value) / bw) ** 2)) / min(n) / min(bw) / sqrt(2 * pi()) AS d FROM gd JOIN events USING (event_type) GROUP BY event_type, k) "
    f"SELECT event_type, k::INT AS k, {s6('g')} AS grid, {s6('d / max(d) OVER (PARTITION BY event_type)')} AS density FROM kd"
)
def kde_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Gaussian density on a fixed grid, scaled to its peak.

    Each value adds to all grid points of its row as an array, so the grid isn't joined to
    the rows: sums of arrays are taken point by point.
    """
    e = _events(spark, sf)
    st = e.groupBy("event_type").agg(
        F.count("*").alias("n"), (F.stddev_samp("value") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("bw"), F.percentile("value", F.lit(0.995)).alias("top")
    )
    j = e.join(st, "event_type")
    at = lambda k: F.col("top") * k / (_GRID - 1)
    sums = [F.sum(F.exp(-0.5 * F.pow((at(k) - F.col("value")) / F.col("bw"), 2))).alias(f"d{k}") for k in range(_GRID)]
    g = j.groupBy("event_type").agg(F.min("top").alias("top"), *sums)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), r6(at(k)).alias("grid"), F.col(f"d{k}").alias("d")) for k in range(_GRID)])
    peak = F.greatest(*[F.col(f"d{k}") for k in range(_GRID)])
    return g.select("event_type", peak.alias("peak"), F.inline(rows)).select("event_type", "k", "grid", r6(F.col("d") / F.col("peak")).alias("density"))


@query()
def linkage_order(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf order of an average-linkage clustering of the 11 points by their standardised summaries.

    Only the 11-row summary reaches Python.
    """
    s = long_points(spark, sf).groupBy("canonical_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("canonical_id")
        v = pdf[["mx", "my", "sx", "sy"]].to_numpy()
        sd = v.std(axis=0)
        v = (v - v.mean(axis=0)) / np.where(sd > 0, sd, 1)
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        groups = [[i] for i in range(len(v))]
        while len(groups) > 1:
            pairs = [(round(d[np.ix_(a, b)].mean(), 12), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
            _, i, j = min(pairs)
            groups[i] = groups[i] + groups.pop(j)
        return pd.DataFrame({"position": np.arange(1, len(v) + 1, dtype=np.int32), "canonical_id": pdf["canonical_id"].to_numpy()[groups[0]]})

    return s.groupBy(F.lit(1).alias("one")).applyInPandas(run, "position int, canonical_id int")


@query()
def quantile_diverse_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Eight records along the quantiles of length whose languages differ where they can.

    Every pick depends on those before it.  Ranks and a short list around each target are
    found by Spark; the greedy choice sees the lists alone: with at most 7 taken ids and as
    many taken languages, the nearest 8 of each language hold every possible pick.
    """
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").filter("lang is not null")
    n = d.count()
    bucket = d.withColumn("b", F.floor(F.log2(F.col("n_chars") + 1)))
    per = bucket.groupBy("b").agg(F.count("*").alias("c"))
    base = per.select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("n_chars", "doc_id")) - 1
    ranked = bucket.withColumn("r", rank).join(base, "b").select("doc_id", "lang", (F.col("r") + F.col("base")).alias("rank"))
    targets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k / 7 * (n - 1)).alias("t")) for k in range(8)])
    near = ranked.select("*", F.inline(targets)).withColumn("distance", F.abs(F.col("rank") - F.col("t")))
    short = near.withColumn("s", F.row_number().over(Window.partitionBy("k", "lang").orderBy("distance", "doc_id"))).filter("s <= 8")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, langs, out = set(), set(), []
        for k, g in pdf.groupby("k", sort=True):
            g = g[~g["doc_id"].isin(ids)].copy()
            g["cost"] = g["distance"] + np.where(g["lang"].isin(langs) & (k not in (0, 7)), float(n), 0.0)
            p = g.sort_values(["cost", "distance", "doc_id"]).iloc[0]
            ids.add(p["doc_id"])
            langs.add(p["lang"])
            out.append((f"q{round(k / 7 * 100):02d}", int(p["doc_id"]), p["lang"]))
        return pd.DataFrame(out, columns=["selection", "doc_id", "lang"])

    return short.groupBy(F.lit(1).alias("one")).applyInPandas(run, "selection string, doc_id bigint, lang string")


def summarize(images: DataFrame, seed: int = stats.SEED, replicates: int = stats.REPLICATES) -> DataFrame:
    """``scope, metric, n, mean, ci95_low, ci95_high`` of :func:`image_metrics`.

    Scopes: overall and by group over detected images, thresholds also over all images, and
    points.  One long table serves all scopes; each metric of a scope is one Python call.
    """
    long = images.select("id", "label", "detected", *_NAMES).unpivot(["id", "label", "detected"], list(_NAMES), "metric", "v")
    group = F.concat(F.lit("group:"), F.col("label").cast("string"))
    whole = F.when(F.col("metric").startswith("pck"), F.lit("all_images"))
    scopes = F.array_compact(F.array(F.when(F.col("detected"), F.lit("overall")), F.when(F.col("detected"), group), whole))
    by_image = long.select(F.explode(scopes).alias("scope"), "metric", "v", "id")
    points = images.filter("detected").select("id", F.posexplode("ne").alias("k", "v"))
    by_point = points.select(F.concat(F.lit("point:"), (F.col("k") + 1).cast("string")).alias("scope"), F.lit("nme").alias("metric"), "v", "id")
    rows = by_image.unionByName(by_point).filter(stats.finite(F.col("v")))
    return stats.bootstrap(rows, ["scope", "metric"], "v", "id", seed, replicates)


@query()
def prediction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summarize(_images(spark, sf), replicates=200)


@query(
    f"WITH b AS (SELECT user_id, event_id, value, min(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), n AS (SELECT *, value <= best AS improved FROM b) "
    f"SELECT event_id, {s6('best')} AS best_so_far, improved, (event_id - max(CASE WHEN improved THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS since_best FROM n"
)
def best_so_far(spark: SparkSession, sf: str) -> DataFrame:
    """The bookkeeping of early stopping over a history: running best and the distance from it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = _events(spark, sf).withColumn("best", F.min("value").over(w)).withColumn("improved", F.col("value") <= F.col("best"))
    last = F.max(F.when(F.col("improved"), F.col("event_id"))).over(w)
    return b.select("event_id", r6(F.col("best")).alias("best_so_far"), "improved", (F.col("event_id") - last).alias("since_best"))
