"""Point geometry as column expressions.

A point set is ``ARRAY<STRUCT<canonical_id: INT, x: DOUBLE, y: DOUBLE>>`` sorted by id, so
that point k is element k - 1 of a complete set.  Nothing here needs a user function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named chords between landmarks, and the landmarks of the contour (fixed values).
CHORDS = {
    "axial_span_1_6": (1, 6),
    "dorsal_base_3_4": (3, 4),
    "caudal_depth_5_7": (5, 7),
    "head_chord_2_10": (2, 10),
    "ventral_base_8_9": (8, 9),
}
CONTOUR = 10
TINY = 1e-12


def at(points: Column, k: int) -> Column:
    return F.get(points, F.lit(k - 1))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def chord(points: Column, a: int, b: int) -> Column:
    return distance(at(points, a), at(points, b))


def _around(points: Column, n: int, term) -> Column:
    """Sum of ``term(p, next p)`` around a closed contour of the first n points."""
    steps = [term(at(points, k), at(points, k % n + 1)) for k in range(1, n + 1)]
    out = steps[0]
    for s in steps[1:]:
        out = out + s
    return out


def perimeter(points: Column, n: int = CONTOUR) -> Column:
    return _around(points, n, distance)


def signed_area(points: Column, n: int = CONTOUR) -> Column:
    """Shoelace area; null if a point is missing."""
    return 0.5 * _around(points, n, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def total(points: Column, value) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + value(p))


def least(points: Column, value) -> Column:
    return F.array_min(F.transform(points, value))


def most(points: Column, value) -> Column:
    return F.array_max(F.transform(points, value))


def centred(points: Column) -> Column:
    """Points about their centroid, as structs of x and y."""
    n = F.size(points)
    cx, cy = total(points, lambda p: p["x"]) / n, total(points, lambda p: p["y"]) / n
    c = F.transform(F.array(F.struct(cx.alias("x"), cy.alias("y"))), lambda c: F.transform(
        points, lambda p: F.struct((p["x"] - c["x"]).alias("x"), (p["y"] - c["y"]).alias("y"))))
    return F.get(c, F.lit(0))


def procrustes_terms(p: Column, t: Column) -> Column:
    """For centred point sets: squared norms and the two products that fix the best rotation."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("pp", "tt", "a", "b")])
    return F.aggregate(
        F.zip_with(p, t, lambda u, v: F.struct(u["x"].alias("px"), u["y"].alias("py"), v["x"].alias("tx"), v["y"].alias("ty"))),
        zero,
        lambda s, r: F.struct(
            (s["pp"] + r["px"] * r["px"] + r["py"] * r["py"]).alias("pp"),
            (s["tt"] + r["tx"] * r["tx"] + r["ty"] * r["ty"]).alias("tt"),
            (s["a"] + r["px"] * r["tx"] + r["py"] * r["ty"]).alias("a"),
            (s["b"] + r["px"] * r["ty"] - r["py"] * r["tx"]).alias("b"),
        ),
    )


def procrustes_rmse(terms: Column, n: Column) -> Column:
    """Root mean square distance after centring, unit scale and the best proper rotation.

    In the plane the rotation has a closed form, and the residual of two unit-norm sets is
    2 - 2 h with h the length of the product vector (a, b).  Null where a set is degenerate.
    """
    norm = F.sqrt(terms["pp"]) * F.sqrt(terms["tt"])
    h = F.hypot(terms["a"], terms["b"]) / norm
    ok = (F.sqrt(terms["pp"]) > TINY) & (F.sqrt(terms["tt"]) > TINY)
    return F.when(ok, F.sqrt(F.greatest(2.0 - 2.0 * h, F.lit(0.0)) / n))


def axial_frame(points: Column) -> Column:
    """Unit axis from point 1 to 6 and the unit normal that points away from point 2."""
    p, q, d = at(points, 1), at(points, 6), at(points, 2)
    length = distance(p, q)
    ux, uy = (q["x"] - p["x"]) / length, (q["y"] - p["y"]) / length
    side = (d["x"] - p["x"]) * -uy + (d["y"] - p["y"]) * ux
    sign = F.when(side > 0, -1.0).otherwise(1.0)
    return F.when(
        length > 1e-6,
        F.struct(length.alias("length"), p["x"].alias("px"), p["y"].alias("py"), ux.alias("ux"), uy.alias("uy"), (-uy * sign).alias("vx"), (ux * sign).alias("vy")),
    )


def axial_extent(points: Column, frame: Column) -> Column:
    """Extents along and across the axis, with margins."""
    u = lambda p: (p["x"] - frame["px"]) * frame["ux"] + (p["y"] - frame["py"]) * frame["uy"]
    v = lambda p: (p["x"] - frame["px"]) * frame["vx"] + (p["y"] - frame["py"]) * frame["vy"]
    n = frame["length"]
    return F.struct(
        F.least(least(points, u) - 0.03 * n, -0.05 * n).alias("u_min"),
        F.greatest(most(points, u) + 0.05 * n, 1.25 * n).alias("u_max"),
        (least(points, v) - 0.08 * n).alias("v_min"),
        (most(points, v) + 0.08 * n).alias("v_max"),
    )


def axial_scale(extent: Column, size: int, inset: float = 8.0) -> Column:
    room = size - 2 * inset
    return F.least(room / (extent["u_max"] - extent["u_min"]), room / (extent["v_max"] - extent["v_min"]))


def axial_matrix(frame: Column, extent: Column, scale: Column, size: int) -> Column:
    """The 2 x 3 affine and the box that the content fills."""
    w, h = (extent["u_max"] - extent["u_min"]) * scale, (extent["v_max"] - extent["v_min"]) * scale
    px, py = (size - w) / 2.0, (size - h) / 2.0
    along = frame["px"] * frame["ux"] + frame["py"] * frame["uy"] + extent["u_min"]
    across = frame["px"] * frame["vx"] + frame["py"] * frame["vy"] + extent["v_min"]
    return F.struct(
        (scale * frame["ux"]).alias("affine_00"), (scale * frame["uy"]).alias("affine_01"), (px - scale * along).alias("affine_02"),
        (scale * frame["vx"]).alias("affine_10"), (scale * frame["vy"]).alias("affine_11"), (py - scale * across).alias("affine_12"),
        px.alias("content_x0"), py.alias("content_y0"), (px + w).alias("content_x1"), (py + h).alias("content_y1"),
        scale.alias("resize_scale"),
    )


def apply_affine(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["affine_00"] * x + m["affine_01"] * y + m["affine_02"], m["affine_10"] * x + m["affine_11"] * y + m["affine_12"]


def invert_affine(m: Column) -> dict[str, Column]:
    """The inverse 2 x 3 matrix; null if there is none."""
    det = m["affine_00"] * m["affine_11"] - m["affine_01"] * m["affine_10"]
    det = F.when(F.abs(det) > TINY, det)
    a, b, c, d = m["affine_11"] / det, -m["affine_01"] / det, -m["affine_10"] / det, m["affine_00"] / det
    return {
        "inverse_00": a, "inverse_01": b, "inverse_02": -(a * m["affine_02"] + b * m["affine_12"]),
        "inverse_10": c, "inverse_11": d, "inverse_12": -(c * m["affine_02"] + d * m["affine_12"]),
    }


def clip(c: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hashed_uniform(key: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on a key alone: 32 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Ranges of the augmentation: degrees, scales, shift as a share of the frame, chance of a mirror image (fixed values).
AUGMENT = {"degrees": 8.0, "low": 0.85, "high": 1.15, "shift": 0.04, "flip": 0.5}


def augment(key: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A reproducible rotation, scale, shift and reflection of points from 0 to 1 about the centre."""
    u = lambda salt: hashed_uniform(key, salt)
    angle = F.radians((2 * u("r") - 1) * AUGMENT["degrees"])
    scale = AUGMENT["low"] + u("s") * (AUGMENT["high"] - AUGMENT["low"])
    dx, dy = ((2 * u(k) - 1) * AUGMENT["shift"] for k in ("x", "y"))
    a, b = (x - 0.5) * scale, (y - 0.5) * scale
    px, py = a * F.cos(angle) - b * F.sin(angle) + 0.5 + dx, a * F.sin(angle) + b * F.cos(angle) + 0.5 + dy
    return F.when(u("f") < AUGMENT["flip"], 1 - px).otherwise(px), py


def integer_box(x0: Column, y0: Column, x1: Column, y1: Column, share: float, width: int, height: int) -> dict[str, Column]:
    """A box padded by a share of its long side, grown to whole pixels and clipped to the frame."""
    pad = share * F.greatest(x1 - x0, y1 - y0)
    return {
        "left": F.greatest(F.floor(x0 - pad), F.lit(0)).cast("long"), "top": F.greatest(F.floor(y0 - pad), F.lit(0)).cast("long"),
        "right": F.least(F.ceil(x1 + pad), F.lit(width)).cast("long"), "bottom": F.least(F.ceil(y1 + pad), F.lit(height)).cast("long"),
    }
