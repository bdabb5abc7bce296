"""Size sources of a refinement plan: from geometry, from selected regions, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import norm, sub, triangle_area, triangle_normal, vec
from ..operators.spatial import box_select, finest_per_cell

#: Fixed values of the automatic size.  Cells along the longest side and the diagonal.
SIDE_CELLS, DIAGONAL_CELLS = 16.0, 28.0
#: More sharp edges than the first number: the size is scaled by the second.
DENSE = ((120, 0.88), (40, 0.92))
#: Shares of the curvature radius, the thickness, the shortest sharp edge and the shortest given edge, and the least each may ask for, in geometric sizes.
WISHES = {"radius": (1 / 6, 0.28), "thickness": (1 / 2, 0.35), "feature": (0.35, 0.4), "edge": (0.3, 0.35)}
#: A thickness asking for less than this is left to local refinement; edges up to these shares of the longest side don't count.
THIN, SHORT, SHORT_GIVEN = 0.2, 0.02, 0.01
#: The size lies between these parts of the diagonal.
FINEST, COARSEST = 80.0, 6.0


def geometry_sources(vertices: DataFrame, h_min: float, h_max: float, per_radius: float = 0.3, per_thickness: float = 0.35) -> DataFrame:
    """(sid, x, y, z, h) of the vertices (vid, x, y, z, kappa, thickness) that ask for less than h_max; nulls ask for nothing."""
    turn = F.when(F.col("kappa") > 1e-12, per_radius / F.col("kappa"))
    wall = F.when(F.col("thickness") > 0, per_thickness * F.col("thickness"))
    h = F.least(F.coalesce(turn, F.lit(h_max)), F.coalesce(wall, F.lit(h_max)))
    return vertices.withColumn("h", h).filter(F.col("h") < h_max).select(F.col("vid").alias("sid"), "x", "y", "z", F.greatest(F.lit(h_min), "h").alias("h"))


def point_sources(points: DataFrame, h: float) -> DataFrame:
    """(sid, x, y, z, h): every point (sid, x, y, z) asks for the same size."""
    return points.select("sid", "x", "y", "z", F.lit(float(h)).alias("h"))


def refinement_plan(geometry: DataFrame, centroids: DataFrame, regions: DataFrame, h: float, band: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(seeds: sid, x, y, z, h; one row: how many of each kind, the band around seeds, the finest size).

    geometry: sources, of which the finest of each half cell counts; centroids of
    surface faces (sid, x, y, z) inside a region (box, lo_x.., hi_x.., share) ask for
    its share of h, a tenth at least.
    """
    half = 0.5 * h
    geo = finest_per_cell(geometry.withColumn("kind", F.lit("geometry")), [F.floor(F.col(c) / half) for c in "xyz"], "h", "sid").select("kind", "sid", "x", "y", "z", "h")
    wanted = F.greatest(F.lit(0.1 * h), F.col("share") * h)
    own = box_select(centroids, regions, ["x", "y", "z"]).select(F.lit("region").alias("kind"), "sid", "x", "y", "z", wanted.alias("h"))
    seeds = geo.unionByName(own).filter(F.col("h") < h)
    return seeds, seeds.agg(F.count_if(F.col("kind") == "geometry").alias("n_geometry"), F.count_if(F.col("kind") == "region").alias("n_region"), F.when(F.count("*") > 0, band * h).otherwise(0.0).alias("seed_band"), F.coalesce(F.min("h"), F.lit(h)).alias("h_fine"))


def auto_size(vertices: DataFrame, cells_across: float = 20.0, least: float = 1e-9) -> float:
    """A size for a part nobody gave one for: its bounding box's diagonal over so many cells."""
    ends = vertices.agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("0", F.min), ("1", F.max))]).first()
    return max(least, sum(((ends[f"{c}1"] or 0.0) - (ends[f"{c}0"] or 0.0)) ** 2 for c in "xyz") ** 0.5 / cells_across)


def mesh_size(triangles: DataFrame, vertices: DataFrame, save, requested: float = 0.0, sharp_degrees: float = 30.0, edge_lengths: DataFrame | None = None) -> dict:
    """A part's size and what it follows from: h, auto, n_sharp, radius, thickness, feature, edge (None: asks for nothing).

    triangles: tid, nodes; vertices: vid, x, y, z; edge_lengths (length): edges known
    beside the triangles.  A size that is asked for is taken as it is.  Otherwise it is
    a part of the extent, lessened for many sharp edges, then by the least curvature
    radius, the least wall thickness and the shortest edges.
    """
    from ..operators.fields import vertex_curvature
    from ..operators.surface import triangles_of
    from ..operators.topology import sharp_edges
    from ..operators.walks import local_thickness

    found = dict.fromkeys(("radius", "thickness", "feature", "edge"))
    if requested > 0:
        return {"h": requested, "auto": False, "n_sharp": 0, **found}
    sides = vertices.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    extent, diagonal = max(s or 0.0 for s in sides), sum((s or 0.0) ** 2 for s in sides) ** 0.5
    t = triangles_of(triangles, vertices).join(triangles.select("tid", "nodes"), "tid")
    normal = triangle_normal(vec("a"), vec("b"), vec("c"))
    t = save(t.select("tid", "nodes", triangle_area(vec("a"), vec("b"), vec("c")).alias("area"), *[n.alias(f"n{c}") for n, c in zip(normal, "xyz", strict=True)]))
    end = lambda n: vertices.select(F.col("vid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    length = norm(sub(vec("a"), vec("b")))
    row = sharp_edges(t, sharp_degrees).join(end("a"), "a").join(end("b"), "b").agg(F.count("*").alias("n"), F.min(F.when(length > SHORT * extent, length)).alias("feature")).first()
    found["feature"] = row["feature"]
    found["radius"] = vertex_curvature(t, vertices).filter("kappa > 1e-9").agg(F.min(1 / F.col("kappa"))).first()[0]
    found["thickness"] = local_thickness(triangles, vertices, save).filter("thickness > 1e-12").agg(F.min("thickness")).first()[0]
    if edge_lengths is not None:
        long, short = edge_lengths.agg(*[F.min(F.when(F.col("length") > F.greatest(F.lit(1e-12), F.lit(s * extent)), F.col("length"))) for s in (SHORT, SHORT_GIVEN)]).first()
        found["edge"] = short if long is None else long
    base = min(extent / SIDE_CELLS, diagonal / DIAGONAL_CELLS) or 0.05
    h = base * next((scale for n, scale in DENSE if row["n"] > n), 1.0)
    for name, (share, least) in WISHES.items():
        wish = None if found[name] is None else share * found[name]
        if wish is None or wish >= h or name == "thickness" and wish <= THIN * base:
            continue
        asked = max(wish, least * base)
        h = min(h, asked) if name == "thickness" else asked
    return {"h": min(max(h, diagonal / FINEST), diagonal / COARSEST) if diagonal else h, "auto": True, "n_sharp": row["n"], **found}
