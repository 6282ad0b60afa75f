"""Landmark geometry: chords, contours, frames, boxes, orientation and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import roles
from plumbline.plans.base import LM, long_points, packed, query, r6, s6

#: A wide row of points for SQL oracles: x1, y1, ..., x11, y11.
_WIDE = (
    "w AS (SELECT id, label, "
    + ", ".join(f"max(x) FILTER (canonical_id = {k}) AS x{k}, max(y) FILTER (canonical_id = {k}) AS y{k}" for k in range(1, 12))
    + " FROM lm GROUP BY id, label)"
)


def _d(a: int, b: int) -> str:
    return f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2)"


@query(f"WITH {LM} SELECT id, canonical_id, {s6('x')} AS x, {s6('y')} AS y FROM lm")
def landmark_long(spark: SparkSession, sf: str) -> DataFrame:
    return long_points(spark, sf).select("id", "canonical_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(
    f"""WITH {LM}, {_WIDE}, a AS (SELECT id, label, {_d(1, 6)} AS length FROM w),
    m AS (SELECT label, quantile_cont(length, 0.5) AS mid FROM a GROUP BY label),
    p AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY round(abs(length - mid), 9), id) AS n FROM a JOIN m USING (label))
    SELECT p.label, lm.id, canonical_id, {s6('x')} AS x, {s6('y')} AS y FROM p JOIN lm ON lm.id = p.id WHERE n = 1"""
)
def representative_specimen_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The specimen of each group whose axis is nearest to the group's median, point by point."""
    axis = packed(spark, sf).select("id", "label", "points", G.chord(F.col("points"), 1, 6).alias("length"))
    mid = axis.groupBy("label").agg(F.percentile("length", F.lit(0.5)).alias("mid"))
    near = Window.partitionBy("label").orderBy(F.round(F.abs(F.col("length") - F.col("mid")), 9), "id")
    ranked = axis.select("id", "label", "length").join(mid, "label").withColumn("n", F.row_number().over(near))
    chosen = ranked.filter("n = 1").select("id")
    picked = axis.join(chosen, "id", "left_semi").select("label", "id", F.inline("points"))
    return picked.select("label", "id", "canonical_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"WITH {LM}, {_WIDE} SELECT id, " + ", ".join(f"{s6(_d(a, b))} AS {n}" for n, (a, b) in G.CHORDS.items()) + " FROM w")
def chord_measurements(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("points")
    return packed(spark, sf).select("id", *[r6(G.chord(p, a, b)).alias(n) for n, (a, b) in G.CHORDS.items()])


@query(f"WITH {LM}, {_WIDE} SELECT id, {s6(' + '.join(_d(k, k % 10 + 1) for k in range(1, 11)))} AS perimeter FROM w")
def contour_perimeter(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("id", r6(G.perimeter(F.col("points"))).alias("perimeter"))


_AREA = " + ".join(f"(x{k} * y{k % 10 + 1} - x{k % 10 + 1} * y{k})" for k in range(1, 11))


@query(f"WITH {LM}, {_WIDE} SELECT id, {s6(f'0.5 * ({_AREA})')} AS area FROM w")
def signed_polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("id", r6(G.signed_area(F.col("points"))).alias("area"))


_FRAME = f"""{LM}, {_WIDE}, ax AS (SELECT *, {_d(1, 6)} AS len, (x6 - x1) / {_d(1, 6)} AS ux, (y6 - y1) / {_d(1, 6)} AS uy FROM w),
fr AS (SELECT *, CASE WHEN (x2 - x1) * -uy + (y2 - y1) * ux > 0 THEN uy ELSE -uy END AS vx,
  CASE WHEN (x2 - x1) * -uy + (y2 - y1) * ux > 0 THEN -ux ELSE ux END AS vy FROM ax),
pr AS (SELECT fr.id, lm.canonical_id, lm.x, lm.y, (lm.x - x1) * ux + (lm.y - y1) * uy AS u, (lm.x - x1) * vx + (lm.y - y1) * vy AS v
  FROM fr JOIN lm USING (id)),
ex AS (SELECT fr.*, least(umin - 0.03 * len, -0.05 * len) AS u_min, greatest(umax + 0.05 * len, 1.25 * len) AS u_max,
  vmin - 0.08 * len AS v_min, vmax + 0.08 * len AS v_max
  FROM fr JOIN (SELECT id, min(u) AS umin, max(u) AS umax, min(v) AS vmin, max(v) AS vmax FROM pr GROUP BY id) USING (id)),
sc AS (SELECT *, least(432 / (u_max - u_min), 432 / (v_max - v_min)) AS s FROM ex),
mt AS (SELECT *, s * ux AS a00, s * uy AS a01, (448 - (u_max - u_min) * s) / 2 - s * (x1 * ux + y1 * uy + u_min) AS a02,
  s * vx AS a10, s * vy AS a11, (448 - (v_max - v_min) * s) / 2 - s * (x1 * vx + y1 * vy + v_min) AS a12 FROM sc)"""


def _affine(spark: SparkSession, sf: str) -> DataFrame:
    """Frames, extents and matrices in stages, so that each expression is evaluated once."""
    df = packed(spark, sf).select("id", "points", G.axial_frame(F.col("points")).alias("f")).filter("f is not null")
    df = df.withColumn("e", G.axial_extent(F.col("points"), F.col("f")))
    df = df.withColumn("s", G.axial_scale(F.col("e"), 448))
    return df.withColumn("m", G.axial_matrix(F.col("f"), F.col("e"), F.col("s"), 448))


@query(
    f"WITH {_FRAME} SELECT id, {s6('len')} AS body_axis_length, {s6('ux')} AS axis_unit_x, {s6('uy')} AS axis_unit_y, {s6('vx')} AS down_unit_x, "
    f"{s6('vy')} AS down_unit_y, {s6('u_min')} AS u_min, {s6('u_max')} AS u_max, {s6('v_min')} AS v_min, {s6('v_max')} AS v_max, "
    + ", ".join(f"{s6(f'a{k}')} AS affine_{k}" for k in ("00", "01", "02", "10", "11", "12"))
    + f", {s6('s')} AS resize_scale FROM mt"
)
def axial_affine_params(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    named = {"body_axis_length": c("f.length"), "axis_unit_x": c("f.ux"), "axis_unit_y": c("f.uy"), "down_unit_x": c("f.vx"), "down_unit_y": c("f.vy")}
    named |= {k: c(f"e.{k}") for k in ("u_min", "u_max", "v_min", "v_max")}
    named |= {f"affine_{k}": c(f"m.affine_{k}") for k in ("00", "01", "02", "10", "11", "12")} | {"resize_scale": c("s")}
    return _affine(spark, sf).select("id", *[r6(v).alias(k) for k, v in named.items()])


@query(
    f"WITH {_FRAME}, q AS (SELECT lm.id, canonical_id, a00 * x + a01 * y + a02 AS px, a10 * x + a11 * y + a12 AS py FROM lm JOIN mt USING (id)) "
    f"SELECT id, canonical_id, {s6('least(greatest(px, 0), 448 - 1e-6)')} AS x_crop_px, {s6('least(greatest(py, 0), 448 - 1e-6)')} AS y_crop_px, "
    f"{s6('least(greatest(px, 0), 448 - 1e-6) / 448')} AS x_crop_normalized, {s6('least(greatest(py, 0), 448 - 1e-6) / 448')} AS y_crop_normalized FROM q"
)
def axial_affine_points(spark: SparkSession, sf: str) -> DataFrame:
    df = _affine(spark, sf).select("id", "m", F.inline("points"))
    x, y = (G.clip(v, 0.0, 448 - 1e-6) for v in G.apply_affine(F.col("m"), F.col("x"), F.col("y")))
    return df.select(
        "id", "canonical_id", r6(x).alias("x_crop_px"), r6(y).alias("y_crop_px"), r6(x / 448).alias("x_crop_normalized"), r6(y / 448).alias("y_crop_normalized")
    )


@query(
    f"WITH {_FRAME}, dt AS (SELECT *, a00 * a11 - a01 * a10 AS det FROM mt) SELECT id, {s6('a11 / det')} AS inverse_00, {s6('-a01 / det')} AS inverse_01, "
    f"{s6('-(a11 / det * a02 - a01 / det * a12)')} AS inverse_02, {s6('-a10 / det')} AS inverse_10, {s6('a00 / det')} AS inverse_11, "
    f"{s6('-(-a10 / det * a02 + a00 / det * a12)')} AS inverse_12 FROM dt"
)
def affine_inverse(spark: SparkSession, sf: str) -> DataFrame:
    inv = G.invert_affine(F.col("m"))
    return _affine(spark, sf).select("id", *[r6(v).alias(k) for k, v in inv.items()])


_BOX = "bx AS (SELECT id, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lm GROUP BY id, label)"
_SIZE = 4.0  # the carrier's coordinates lie within a few units; a frame of this size about 0


def _box(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("points")
    x, y = (lambda q: q["x"]), (lambda q: q["y"])
    return packed(spark, sf).select(
        "id", "label", G.least(p, x).alias("x0"), G.most(p, x).alias("x1"), G.least(p, y).alias("y0"), G.most(p, y).alias("y1")
    )


@query(
    f"WITH {LM}, {_BOX}, pd AS (SELECT *, 0.08 * greatest(x1 - x0, y1 - y0) AS pad FROM bx) SELECT id, "
    + ", ".join(f"{s6(f'least(greatest({e}, -{_SIZE}), {_SIZE})')} AS {n}" for n, e in (("left_px", "x0 - pad"), ("top_px", "y0 - pad"), ("right_px", "x1 + pad"), ("bottom_px", "y1 + pad")))
    + " FROM pd"
)
def padded_landmark_bbox(spark: SparkSession, sf: str) -> DataFrame:
    c, pad = F.col, 0.08 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    ends = {"left_px": c("x0") - pad, "top_px": c("y0") - pad, "right_px": c("x1") + pad, "bottom_px": c("y1") + pad}
    return _box(spark, sf).select("id", *[r6(G.clip(v, -_SIZE, _SIZE)).alias(k) for k, v in ends.items()])


@query(
    """WITH d AS (SELECT p_partkey AS id, (p_size * 7 + 3)::DOUBLE AS w, (p_partkey % 97 + 11)::DOUBLE AS h FROM part),
    z AS (SELECT *, least(448 / w, 448 / h) AS s FROM d), n AS (SELECT *, greatest(1, round_even(w * s, 0))::BIGINT AS nw, greatest(1, round_even(h * s, 0))::BIGINT AS nh FROM z)
    SELECT id, """
    + s6("s")
    + " AS scale, nw AS resized_width, nh AS resized_height, (448 - nw) // 2 AS pad_x, (448 - nh) // 2 AS pad_y FROM n"
)
def letterbox_params(spark: SparkSession, sf: str) -> DataFrame:
    from plumbline.plans.base import table

    df = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") * 7 + 3).cast("double").alias("w"), (F.col("p_partkey") % 97 + 11).cast("double").alias("h")
    )
    df = df.withColumn("s", F.least(448 / F.col("w"), 448 / F.col("h")))
    side = lambda n: F.greatest(F.lit(1), F.bround(F.col(n) * F.col("s"), 0).cast("long"))
    df = df.select("id", r6(F.col("s")).alias("scale"), side("w").cast("long").alias("resized_width"), side("h").cast("long").alias("resized_height"))
    pad = lambda n: F.floor((448 - F.col(n)) / 2).cast("long")
    return df.withColumns({"pad_x": pad("resized_width"), "pad_y": pad("resized_height")})


_CLIPPED = ", ".join(f"least(greatest({c}, -{_SIZE}), {_SIZE}) AS {c}" for c in ("x0", "x1", "y0", "y1"))


@query(
    f"WITH {LM}, {_BOX}, cl AS (SELECT id, {_CLIPPED} FROM bx), wh AS (SELECT *, greatest(x1 - x0, 1e-6) AS w, greatest(y1 - y0, 1e-6) AS h FROM cl) SELECT id, "
    f"{s6('(x0 + w / 2) / 8')} AS cx, {s6('(y0 + h / 2) / 8')} AS cy, {s6('w / 8')} AS box_w, {s6('h / 8')} AS box_h, {s6('x0')} AS coco_x, {s6('y0')} AS coco_y, {s6('w * h')} AS area FROM wh"
)
def yolo_coco_bbox(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf).select("id", *[G.clip(F.col(c), -_SIZE, _SIZE).alias(c) for c in ("x0", "x1", "y0", "y1")])
    b = b.withColumns({"w": F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6)), "h": F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))})
    c, full = F.col, 2 * _SIZE
    named = {"cx": (c("x0") + c("w") / 2) / full, "cy": (c("y0") + c("h") / 2) / full, "box_w": c("w") / full, "box_h": c("h") / full}
    named |= {"coco_x": c("x0"), "coco_y": c("y0"), "area": c("w") * c("h")}
    return b.select("id", *[r6(v).alias(k) for k, v in named.items()])


@query(
    f"WITH {LM}, ok AS (SELECT id, count(*) FILTER (x > -0.2) AS n, min(x) FILTER (x > -0.2) AS x0, max(x) FILTER (x > -0.2) AS x1, min(y) FILTER (x > -0.2) AS y0, max(y) FILTER (x > -0.2) AS y1 FROM lm GROUP BY id), "
    "m AS (SELECT *, greatest(0.24, 0.12 * greatest(x1 - x0, y1 - y0)) AS g FROM ok) SELECT id, n AS valid_points, "
    + ", ".join(f"{s6(f'CASE WHEN n < 2 THEN {full} ELSE least(greatest({e}, -{_SIZE}), {_SIZE}) END')} AS {k}" for k, e, full in (("left_px", "x0 - g", -_SIZE), ("right_px", "x1 + g", _SIZE), ("top_px", "y0 - g", -_SIZE), ("bottom_px", "y1 + g", _SIZE)))
    + " FROM m"
)
def crop_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Limits about the valid points with a least margin; the whole frame under two of them."""
    df = packed(spark, sf).select("id", F.filter("points", lambda p: p["x"] > -0.2).alias("p"))
    p, x, y = F.col("p"), (lambda q: q["x"]), (lambda q: q["y"])
    df = df.select("id", F.size("p").cast("long").alias("n"), G.least(p, x).alias("x0"), G.most(p, x).alias("x1"), G.least(p, y).alias("y0"), G.most(p, y).alias("y1"))
    g = F.greatest(F.lit(0.24), 0.12 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    ends = {"left_px": (F.col("x0") - g, -_SIZE), "right_px": (F.col("x1") + g, _SIZE), "top_px": (F.col("y0") - g, -_SIZE), "bottom_px": (F.col("y1") + g, _SIZE)}
    return df.select("id", F.col("n").alias("valid_points"), *[r6(F.when(F.col("n") < 2, full).otherwise(G.clip(v, -_SIZE, _SIZE))).alias(k) for k, (v, full) in ends.items()])


_ORIENT = f"""{LM}, {_WIDE}, o AS (SELECT id, label, x6 - x1 AS dx, y6 - y1 AS dy, x1, y1, x2, y2, x10, y10,
  0.5 * (x8 + x9) AS sx, 0.5 * (y8 + y9) AS sy, id % 3 = 0 AS scaled FROM w),
cr AS (SELECT *, dx * (y2 - y1) - dy * (x2 - x1) AS c2, dx * (y10 - y1) - dy * (x10 - x1) AS c10, dx * (sy - y1) - dy * (sx - x1) AS cs FROM o),
md AS (SELECT id, scaled AND abs(cs) > 1e-6 AND c2 * c10 < 0 AS by_scale, abs(dx) / greatest(sqrt(dx * dx + dy * dy), 1e-9) < 0.7 AS oblique, c2 * cs > 0 AS same, y2 < y10 AS up,
  degrees(atan2(dy, dx)) AS angle FROM cr),
mode AS (SELECT id, CASE WHEN by_scale THEN CASE WHEN same THEN 'direct' ELSE 'reverse' END WHEN oblique THEN 'ambiguous' WHEN up THEN 'direct' ELSE 'reverse' END AS mode,
  CASE WHEN by_scale THEN 'scale_side_geometry_unconfirmed_convention' WHEN oblique THEN 'oblique_or_vertical_body_axis' ELSE 'horizontal_branch_geometry' END AS reason, angle FROM md)"""


def _oriented(spark: SparkSession, sf: str) -> DataFrame:
    """Every third carrier has a scale: points 8 and 9 stand for its ends."""
    p = F.col("points")
    ends = F.when(F.col("id") % 3 == 0, F.array(G.at(p, 8), G.at(p, 9)))
    return packed(spark, sf).select("id", "points", roles.orientation(p, ends).alias("o"))


@query(f"WITH {_ORIENT} SELECT id, mode, reason, {s6('angle')} AS angle FROM mode")
def orientation_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _oriented(spark, sf).select("id", "o.mode", "o.reason", r6(F.col("o.angle")).alias("angle"))


@query(
    f"WITH {_ORIENT} SELECT lm.id, CASE WHEN mode = 'direct' OR canonical_id IN (1, 6, 11) THEN canonical_id ELSE (12 - canonical_id) END::INT AS canonical_id, "
    f"canonical_id AS raw_id, {s6('x')} AS x, {s6('y')} AS y FROM mode JOIN lm USING (id) WHERE mode IN ('direct', 'reverse')"
)
def canonical_permutation(spark: SparkSession, sf: str) -> DataFrame:
    df = _oriented(spark, sf).select("id", F.col("o.mode").alias("mode"), F.inline("points"))
    out = roles.canonicalise(df.withColumnRenamed("canonical_id", "raw_id"), spark)
    return out.select("id", "canonical_id", "raw_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


_CHECKS_SQL = roles.topology_sql()


@query(f"WITH {LM}, {_WIDE} SELECT id, " + ", ".join(f"({e}) AS {n}" for n, e in _CHECKS_SQL.items()) + " FROM w")
def topology_checks(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("id", *[c.alias(n) for n, c in roles.topology(F.col("points")).items()])


@query(
    f"WITH {LM}, {_WIDE}, c AS (SELECT id, "
    + ", ".join(f"({e}) AS {n}" for n, e in _CHECKS_SQL.items())
    + " FROM w), l AS (UNPIVOT c ON "
    + ", ".join(_CHECKS_SQL)
    + " INTO NAME check_name VALUE ok) SELECT check_name, count(*) FILTER (ok)::BIGINT AS pass_count, count(*) FILTER (NOT ok)::BIGINT AS violations, "
    + f"{s6('avg(ok::INT)')} AS pass_fraction, min(id) FILTER (NOT ok) AS first_violation FROM l GROUP BY check_name"
)
def topology_summary(spark: SparkSession, sf: str) -> DataFrame:
    wide = topology_checks(spark, sf)
    long = wide.unpivot("id", list(_CHECKS_SQL), "check_name", "ok")
    ok = F.col("ok")
    return long.groupBy("check_name").agg(
        F.count(F.when(ok, 1)).alias("pass_count"),
        F.count(F.when(~ok, 1)).alias("violations"),
        r6(F.avg(ok.cast("int"))).alias("pass_fraction"),
        F.min(F.when(~ok, F.col("id"))).alias("first_violation"),
    )


@query(f"WITH {LM} SELECT id, canonical_id, {s6('CASE WHEN id % 2 = 1 THEN y ELSE x END')} AS x, {s6('CASE WHEN id % 2 = 1 THEN 447 - x ELSE y END')} AS y FROM lm")
def point_remap_rotate(spark: SparkSession, sf: str) -> DataFrame:
    """Points of tall frames (odd ids here) follow their image by a quarter turn."""
    tall = F.col("id") % 2 == 1
    x, y = F.when(tall, F.col("y")).otherwise(F.col("x")), F.when(tall, 447 - F.col("x")).otherwise(F.col("y"))
    return long_points(spark, sf).select("id", "canonical_id", r6(x).alias("x"), r6(y).alias("y"))


@query(f"WITH {LM}, {_WIDE} SELECT id, {s6(f'greatest({_d(1, 6)}, 1e-12)')} AS body_axis, {s6('greatest(sqrt((x1 - x4) ** 2 + (y1 - y4) ** 2), 1e-12)')} AS diagonal, {s6(f'greatest({_d(1, 6)}, 1e-12) / greatest(sqrt((x1 - x4) ** 2 + (y1 - y4) ** 2), 1e-12)')} AS ratio FROM w")
def normaliser_columns(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("points")
    axis, diagonal = F.greatest(G.chord(p, 1, 6), F.lit(G.TINY)), F.greatest(G.chord(p, 1, 4), F.lit(G.TINY))
    return packed(spark, sf).select("id", r6(axis).alias("body_axis"), r6(diagonal).alias("diagonal"), r6(axis / diagonal).alias("ratio"))


_RND = lambda salt: f"(('0x' || substr(md5(id::VARCHAR || '{salt}'), 1, 8))::BIGINT / 4294967296.0)"


@query(
    f"WITH {LM}, rn AS (SELECT id, canonical_id, x / 8 + 0.5 AS x, y / 8 + 0.5 AS y, radians((2 * {_RND('r')} - 1) * 8) AS a, 0.85 + {_RND('s')} * 0.3 AS s, (2 * {_RND('x')} - 1) * 0.04 AS dx, (2 * {_RND('y')} - 1) * 0.04 AS dy, {_RND('f')} < 0.5 AS flip FROM lm), "
    "tp AS (SELECT id, canonical_id, flip, (x - 0.5) * s * cos(a) - (y - 0.5) * s * sin(a) + 0.5 + dx AS px, (x - 0.5) * s * sin(a) + (y - 0.5) * s * cos(a) + 0.5 + dy AS py FROM rn) "
    f"SELECT id, canonical_id, {s6('CASE WHEN flip THEN 1 - px ELSE px END')} AS x, {s6('py')} AS y FROM tp"
)
def augmented_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y = G.augment(F.col("id"), F.col("x") / 8 + 0.5, F.col("y") / 8 + 0.5)
    return long_points(spark, sf).select("id", "canonical_id", r6(x).alias("x"), r6(y).alias("y"))


@query(
    f"WITH {LM}, {_BOX}, px AS (SELECT id, (x0 / 8 + 0.5) * 640 AS x0, (x1 / 8 + 0.5) * 640 AS x1, (y0 / 8 + 0.5) * 480 AS y0, (y1 / 8 + 0.5) * 480 AS y1 FROM bx), pd AS (SELECT *, 0.08 * greatest(x1 - x0, y1 - y0) AS pad FROM px) "
    'SELECT id, greatest(floor(x0 - pad), 0)::BIGINT AS "left", greatest(floor(y0 - pad), 0)::BIGINT AS top, least(ceil(x1 + pad), 640)::BIGINT AS "right", least(ceil(y1 + pad), 480)::BIGINT AS bottom FROM pd'
)
def padded_crop_box(spark: SparkSession, sf: str) -> DataFrame:
    b = _box(spark, sf)
    x0, x1, y0, y1 = ((F.col(c) / 8 + 0.5) * n for c, n in (("x0", 640), ("x1", 640), ("y0", 480), ("y1", 480)))
    return b.select("id", *[c.alias(k) for k, c in G.integer_box(x0, y0, x1, y1, 0.08, 640, 480).items()])
