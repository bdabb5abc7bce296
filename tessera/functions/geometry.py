"""Vectors, triangles, tetrahedra and stresses, as column expressions.

A vector is a tuple of three columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """Columns <prefix>x, <prefix>y, <prefix>z."""
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def in_box(p: Vec, lo: Vec, hi: Vec) -> Column:
    """Inclusive on all sides."""
    test = p[0].between(lo[0], hi[0])
    return test & p[1].between(lo[1], hi[1]) & p[2].between(lo[2], hi[2])


def ordered_box(a: Vec, b: Vec) -> tuple[Vec, Vec]:
    """Two corners in any order as (low, high)."""
    return tuple(F.least(p, q) for p, q in zip(a, b, strict=True)), tuple(F.greatest(p, q) for p, q in zip(a, b, strict=True))


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """Unit normal; +z for a degenerate triangle."""
    n = cross(sub(b, a), sub(c, a))
    size = norm(n)
    return tuple(F.when(size > 0, x / F.nullif(size, F.lit(0.0))).otherwise(F.lit(d)) for x, d in zip(n, (0.0, 0.0, 1.0), strict=True))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def quad_area(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Two triangles; a triangle is coded by d = c and adds nothing."""
    return triangle_area(a, b, c) + triangle_area(a, c, d)


def polygon_area(points: str) -> Column:
    """The area of a flat polygon, given as an array of points (arrays of three)."""
    at = lambda k: tuple(F.element_at(F.col(points), k)[n] for n in range(3))
    inner, first = F.sequence(F.lit(2), F.size(points) - 1), at(F.lit(1))

    def along(n: int) -> Column:
        return F.aggregate(inner, F.lit(0.0), lambda a, k: a + cross(sub(at(k), first), sub(at(k + 1), first))[n])

    return norm(tuple(along(n) for n in range(3))) / 2


def centroid(*points: Vec) -> Vec:
    return tuple(sum((p[i] for p in points[1:]), points[0][i]) / len(points) for i in range(3))


def tet_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed."""
    return dot(sub(b, a), cross(sub(c, a), sub(d, a))) / 6


def prism_volume(p: list[Vec]) -> Column:
    """Signed, as three tetrahedra."""
    return tet_volume(p[0], p[1], p[2], p[3]) + tet_volume(p[1], p[2], p[3], p[4]) + tet_volume(p[2], p[3], p[4], p[5])


def tet_aspect(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """min(1, 6 sqrt(2) |V| / longest edge cubed): 1 for a regular tetrahedron, 0 for an inverted or flat one."""
    pairs = ((a, b), (a, c), (a, d), (b, c), (b, d), (c, d))
    longest = F.greatest(*[norm(sub(q, p)) for p, q in pairs])
    v = tet_volume(a, b, c, d)
    return F.when(v <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 6 * 2**0.5 * v / F.nullif(F.pow(longest, F.lit(3.0)), F.lit(0.0))))


def von_mises(xx: Column, yy: Column, zz: Column, yz: Column, xz: Column, xy: Column) -> Column:
    return F.sqrt(((xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)) / 2 + 3 * (yz * yz + xz * xz + xy * xy))


def lame(young: Column, poisson: Column) -> tuple[Column, Column]:
    """(lambda, mu)."""
    return young * poisson / ((1 + poisson) * (1 - 2 * poisson)), young / (2 * (1 + poisson))


def segment_distance2(p: Vec, a: Vec, b: Vec) -> Column:
    """Squared distance to a segment (to its end where it has no length)."""
    ab, ap = sub(b, a), sub(p, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot(ap, ab) / F.nullif(dot(ab, ab), F.lit(0.0)), F.lit(0.0))))
    d = tuple(x - t * y for x, y in zip(ap, ab, strict=True))
    return dot(d, d)


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    """The point of a segment nearest to p."""
    ab, ap = sub(b, a), sub(p, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot(ap, ab) / F.nullif(dot(ab, ab), F.lit(0.0)), F.lit(0.0))))
    return tuple(x + t * y for x, y in zip(a, ab, strict=True))


def closest_on_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """(d2, x, y, z) of the point of a triangle nearest to p.

    The foot of the perpendicular where its barycentric coordinates say that it lies
    inside, else the nearest point of the three sides; a flat triangle is its sides.
    """
    n = cross(sub(b, a), sub(c, a))
    size = F.nullif(dot(n, n), F.lit(0.0))
    ap = sub(p, a)
    v, w = dot(cross(ap, sub(c, a)), n) / size, dot(cross(sub(b, a), ap), n) / size
    height = dot(ap, n) / size

    def at(q: Vec) -> Column:
        d = sub(p, q)
        return F.struct(dot(d, d).alias("d2"), *[x.alias(k) for x, k in zip(q, "xyz", strict=True)])

    foot = at(tuple(x - height * y for x, y in zip(p, n, strict=True)))
    return F.when((v >= 0) & (w >= 0) & (v + w <= 1), foot).otherwise(F.least(*[at(closest_on_segment(p, s, e)) for s, e in ((a, b), (b, c), (c, a))]))


def triangle_distance2_steps() -> tuple[list[dict[str, Column]], Column]:
    """The d2 of ``closest_on_triangle`` over columns p., a., b., c. for very many pairs, in steps like ``ray_triangle_steps``."""
    put = lambda n, v: {f"_{n}{c}": x for c, x in zip("xyz", v, strict=True)}
    p, a, b, c, n = vec("p"), vec("a"), vec("b"), vec("c"), vec("_n")
    sides = {"1": (a, b), "2": (b, c), "3": (c, a)}  # _s the side, _r from its start to p, _t where the nearest point is
    e, f, r = vec("_s1"), vec("_f"), vec("_r1")
    size, v, w, height = (F.col(f"_{x}") for x in ("size", "v", "w", "height"))
    first, share, apart = put("f", sub(c, a)), {}, {}
    for k, (s, to) in sides.items():
        first |= put(f"s{k}", sub(to, s)) | put(f"r{k}", sub(p, s))
        side = vec(f"_s{k}")
        share[f"_t{k}"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot(vec(f"_r{k}"), side) / F.nullif(dot(side, side), F.lit(0.0)), F.lit(0.0))))
        apart |= put(f"d{k}", sub(p, tuple(x + F.col(f"_t{k}") * y for x, y in zip(s, side, strict=True))))
    steps = [
        first,
        put("n", cross(e, f)) | put("g", cross(r, f)) | put("h", cross(e, r)) | share,
        {"_size": F.nullif(dot(n, n), F.lit(0.0))},
        {"_v": dot(vec("_g"), n) / size, "_w": dot(vec("_h"), n) / size, "_height": dot(r, n) / size},
        apart | put("d0", sub(p, tuple(x - height * y for x, y in zip(p, n, strict=True)))),
        {f"_q{k}": dot(vec(f"_d{k}"), vec(f"_d{k}")) for k in "0123"},
    ]
    return steps, F.when((v >= 0) & (w >= 0) & (v + w <= 1), F.col("_q0")).otherwise(F.least("_q1", "_q2", "_q3"))


def ray_triangle(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec, eps: float = 1e-12) -> Column:
    """Distance along the ray to the triangle, or null (determinant form)."""
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(direction, e2)
    det = F.nullif(F.when(F.abs(dot(e1, p)) < eps, F.lit(0.0)).otherwise(dot(e1, p)), F.lit(0.0))
    t = sub(origin, a)
    u = dot(t, p) / det
    q = cross(t, e1)
    v = dot(direction, q) / det
    w = dot(e2, q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (w > eps), w)


def ray_triangle_steps(eps: float = 1e-12) -> tuple[list[dict[str, Column]], Column]:
    """``ray_triangle`` over columns o., d., a., b., c. for very many pairs: columns to add one step after the other, and the distance from them.

    As one expression, what is used twice is worked out again each time, and a filter
    on it is more code than the JVM compiles.  A filter right after the steps would
    make it one again: aggregate first.
    """
    put = lambda n, v: {f"_{n}{c}": x for c, x in zip("xyz", v, strict=True)}
    e1, e2, p, t, q = (vec(f"_{n}") for n in ("e", "f", "p", "t", "q"))
    det, raw, u, v, w = (F.col(f"_{n}") for n in ("det", "raw", "u", "v", "w"))
    steps = [
        put("e", sub(vec("b"), vec("a"))) | put("f", sub(vec("c"), vec("a"))) | put("t", sub(vec("o"), vec("a"))),
        put("p", cross(vec("d"), e2)) | put("q", cross(t, e1)),
        {"_raw": dot(e1, p)},
        {"_det": F.nullif(F.when(F.abs(raw) < eps, F.lit(0.0)).otherwise(raw), F.lit(0.0))},
        {"_u": dot(t, p) / det, "_v": dot(vec("d"), q) / det, "_w": dot(e2, q) / det},
    ]
    return steps, F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (w > eps), w)


def menger_curvature(a: Vec, b: Vec, c: Vec) -> Column:
    """Four times the area over the product of the sides; 0 for a side without length."""
    sides = norm(sub(b, a)) * norm(sub(c, b)) * norm(sub(c, a))
    return F.coalesce(4 * triangle_area(a, b, c) / F.nullif(sides, F.lit(0.0)), F.lit(0.0))


def at_fraction(samples: Column, fraction: Column) -> Column:
    """Linear interpolation in an array at a fraction 0..1 of its length."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * (F.size(samples) - 1)
    i = F.least(F.floor(x).cast("int"), F.greatest(F.size(samples) - 2, F.lit(0)))
    low, high = F.element_at(samples, i + 1), F.element_at(samples, F.least(i + 2, F.size(samples)))
    return F.when(F.size(samples) > 0, low + (high - low) * (x - i))


def cylindrical(p: Vec, origin: Vec, axis: int) -> tuple[Column, Column, Column]:
    """(radius, angle, height) about a coordinate axis."""
    d = sub(p, origin)
    u, v = d[(axis + 1) % 3], d[(axis + 2) % 3]
    return F.sqrt(u * u + v * v), F.atan2(v, u), d[axis]


def dominant_axis(a: Vec) -> Column:
    """Place of the component that is largest in size, the first on ties."""
    x, y, z = (F.abs(c) for c in a)
    return F.when((x >= y) & (x >= z), F.lit(0)).when(y >= z, F.lit(1)).otherwise(F.lit(2))


def hash01(i: Column, seed: int = 0) -> Column:
    """A reproducible jitter in 0..1 from an integer, by 32-bit mixing in BIGINT."""
    m = F.lit((1 << 32) - 1)
    mul = lambda x, k: ((x.bitwiseAND(F.lit(0xFFFF)) * k) + F.shiftleft((F.shiftright(x, 16) * k).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(m)
    x = (i.cast("long") + seed).bitwiseAND(m)
    for shift, k in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = mul(x.bitwiseXOR(F.shiftright(x, shift)), k)
    return x.bitwiseXOR(F.shiftright(x, 16)).cast("double") / float((1 << 32) - 1)


def hash_signed(i: Column, j: Column, k: Column, axis: int) -> Column:
    """A reproducible jitter in -1..1 from lattice indexes and an axis (products in 32 bits, wrapping)."""
    m = F.lit((1 << 32) - 1)
    mul = lambda x, n: F.pmod(x.cast("long") * n, F.lit(1 << 32))  # noqa: E731  indexes are below 2**30
    key = mul(i, 73856093).bitwiseXOR(mul(j, 19349663)).bitwiseXOR(mul(k, 83492791)).bitwiseXOR(F.lit(axis * 2654435761 % (1 << 32)))
    return 2 * hash01(key.bitwiseAND(m)) - 1


def density(h: Column) -> Column:
    return 1 / (h * h * h)


def graded_size(h_min: Column, slope: Column, distance: Column, h_max: Column) -> Column:
    """h_min + slope * distance, kept between h_min and h_max."""
    return F.greatest(h_min, F.least(h_max, h_min + slope * distance))


def blended_size(h_min: Column, h_max: Column, distance: Column, reach: Column) -> Column:
    """From h_min at the feature to h_max at ``reach`` and beyond, linearly."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance / F.nullif(reach, F.lit(0.0))))
    return F.coalesce(h_min + (h_max - h_min) * t, h_max)


def feature_size(kappa: Column, thickness: Column, per_radius: float, per_thickness: float, h_min: Column, h_max: Column) -> Column:
    """The smaller of a share of the curvature radius and of the thickness, clamped; nulls don't bind."""
    parts = F.least(F.coalesce(per_radius / F.nullif(kappa, F.lit(0.0)), h_max), F.coalesce(per_thickness * thickness, h_max))
    return F.greatest(h_min, F.least(h_max, parts))
