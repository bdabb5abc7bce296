"""Regular lattices as relations: cells, template fills, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six tetrahedra of a cube along its main diagonal, as corner numbers x + 2 y + 4 z.
KUHN = [(0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)]
#: The corners of a cube in the node order of a hexahedron, and its two prisms.
HEX = [(0, 1, 3, 2, 4, 5, 7, 6)]
PRISMS = [(0, 1, 3, 4, 5, 7), (0, 3, 2, 4, 7, 6)]
TEMPLATES = {"tet4": KUHN, "hex8": HEX, "prism6": PRISMS}
MOST_CELLS = 512 * 1024


def fit_counts(extent: tuple[float, float, float], h: float, budget: int = MOST_CELLS) -> tuple[tuple[int, int, int], float]:
    """Cells along each axis and the size, enlarged until they fit the budget."""
    while True:
        counts = tuple(max(1, -int(-e // h)) for e in extent)
        if counts[0] * counts[1] * counts[2] <= budget:
            return counts, h
        h *= (counts[0] * counts[1] * counts[2] / budget) ** (1 / 3) * 1.0001


def cells(spark: SparkSession, counts: tuple[int, int, int]) -> DataFrame:
    """(cell, i, j, k) of a lattice, numbered with i fastest."""
    nx, ny, nz = counts
    c = F.col("id")
    return spark.range(nx * ny * nz).select(c.alias("cell"), (c % nx).alias("i"), (F.floor(c / nx) % ny).alias("j"), F.floor(c / (nx * ny)).alias("k"))


def corner_id(i: Column, j: Column, k: Column, counts: tuple[int, int, int]) -> Column:
    return (k * (counts[1] + 1) + j) * (counts[0] + 1) + i


def fill(inside: DataFrame, counts: tuple[int, int, int], etype: str = "tet4") -> DataFrame:
    """(eid, etype, nodes) of the template's elements in each cell; node ids are lattice indexes, so no map is needed."""
    template = TEMPLATES[etype]
    corner = lambda n: corner_id(F.col("i") + n % 2, F.col("j") + n // 2 % 2, F.col("k") + n // 4, counts)
    own = F.array(*[F.array(*[corner(n) for n in t]) for t in template])
    return inside.select("cell", F.posexplode(own).alias("t", "nodes")).select((F.col("cell") * len(template) + F.col("t")).alias("eid"), F.lit(etype).alias("etype"), F.col("nodes").cast("array<long>").alias("nodes"), F.lit(None).cast("array<array<int>>").alias("faces"))


def sweep_axis(extent: tuple[float, float, float]) -> int:
    """The longest side (0, 1, 2); of equal ones the last."""
    return max(range(3), key=lambda a: (extent[a], a))


def sweep_fill(inside: DataFrame, counts: tuple[int, int, int], axis: int) -> DataFrame:
    """(eid, etype, nodes, faces): two prisms a cell, their triangles across ``axis``, so layers follow each other along it."""
    step = (1, counts[0] + 1, (counts[0] + 1) * (counts[1] + 1))
    turned = [step[(axis + 1 + b) % 3] for b in range(3)]  # the axis takes the place of z, the others keep their turn
    corner = lambda n: corner_id(F.col("i"), F.col("j"), F.col("k"), counts) + sum(s for b, s in enumerate(turned) if n >> b & 1)
    own = F.array(*[F.array(*[corner(n) for n in t]) for t in PRISMS])
    return inside.select("cell", F.posexplode(own).alias("t", "n")).select((F.col("cell") * 2 + F.col("t")).alias("eid"), *_element("prism6", F.col("n")))


def sweep_surface(triangles: DataFrame, extent: tuple[float, float, float], h: float, spark: SparkSession) -> tuple[DataFrame, DataFrame, int]:
    """(elements, nodes, axis): prisms swept along the longest side of a closed surface (ax.., bx.., cx..) whose box starts at the origin.

    Each column of cells is filled between where the surface is entered and left.
    """
    counts, h = fit_counts(extent, h)
    axis = sweep_axis(extent)
    elements = sweep_fill(classify(triangles, counts, h, spark, "xyz"[axis]), counts, axis)
    used = elements.select(F.explode("nodes").alias("nid")).distinct()
    return elements, lattice_nodes(spark, counts, h).join(used, "nid", "left_semi"), axis


def lattice_nodes(spark: SparkSession, counts: tuple[int, int, int], h: float) -> DataFrame:
    nx, ny = counts[0] + 1, counts[1] + 1
    c = F.col("id")
    return spark.range(nx * ny * (counts[2] + 1)).select(c.alias("nid"), (c % nx * h).cast("double").alias("x"), (F.floor(c / nx) % ny * h).cast("double").alias("y"), (F.floor(c / (nx * ny)) * h).cast("double").alias("z"))


def node_counts(etype: str, n: int) -> int:
    """Closed-form nodes of an n x n x n structured block."""
    linear = (n + 1) ** 3
    if etype in ("tet4", "hex8"):
        return linear
    if etype == "hex20":
        return linear + 3 * n * (n + 1) ** 2
    if etype == "tet10":
        return (2 * n + 1) ** 3
    raise ValueError(etype)


def classify(triangles: DataFrame, counts: tuple[int, int, int], h: float, spark: SparkSession, axis: str = "z") -> DataFrame:
    """Cells whose centre lies inside a closed surface: parity of the crossings below it in its column along ``axis``."""
    from ..operators.ordered import parity_inside
    from ..operators.spatial import columns_under

    k = "xyz".index(axis)
    turn = {c: "xyz"[("xyz".index(c) + k + 1) % 3] for c in "xyz"}  # the axis takes the place of z
    turned = triangles.select(*[F.col(f"{n}{turn[c]}").alias(f"{n}{c}") for n in "abc" for c in "xyz"])
    cross = columns_under(turned, h).select(F.struct("i", "j").alias("column"), "z")
    place = dict(zip("xyz", "ijk", strict=True))
    points = cells(spark, counts).withColumn("column", F.struct(F.col(place[turn["x"]]).alias("i"), F.col(place[turn["y"]]).alias("j"))).withColumn("cz", (F.col(place[axis]) + 0.5) * h)
    return parity_inside(cross, points, "column", "z", "cz").filter("inside").drop("column", "cz", "n_below", "inside")


#: The six sides of a cell: step to the neighbour, corners x + 2 y + 4 z in order, outward.
SIDES = [((-1, 0, 0), (0, 4, 6, 2)), ((1, 0, 0), (1, 3, 7, 5)), ((0, -1, 0), (0, 1, 5, 4)), ((0, 1, 0), (2, 6, 7, 3)), ((0, 0, -1), (0, 2, 3, 1)), ((0, 0, 1), (4, 5, 7, 6))]


def open_sides(inside: DataFrame) -> DataFrame:
    """(cell, i, j, k, side): the sides of inside cells whose neighbour isn't inside."""
    steps = F.array(*[F.struct(F.lit(s).alias("side"), *[F.lit(d).alias(f"d{n}") for d, n in zip(step, "ijk", strict=True)]) for s, (step, _) in enumerate(SIDES)])
    all_sides = inside.select("cell", "i", "j", "k", F.explode(steps).alias("s")).select("cell", "i", "j", "k", "s.side", *[(F.col(n) + F.col(f"s.d{n}")).alias(f"n{n}") for n in "ijk"])
    others = inside.select(*[F.col(n).alias(f"n{n}") for n in "ijk"])
    return all_sides.join(others, ["ni", "nj", "nk"], "left_anti").select("cell", "i", "j", "k", "side")


def _corner(n: int, counts: tuple[int, int, int]) -> Column:
    return corner_id(F.col("i") + n % 2, F.col("j") + n // 2 % 2, F.col("k") + n // 4, counts)


def _element(etype: str, nodes: Column) -> list[Column]:
    return [F.lit(etype).alias("etype"), nodes.cast("array<long>").alias("nodes"), F.lit(None).cast("array<array<int>>").alias("faces")]


def centre_id(counts: tuple[int, int, int]) -> Column:
    """The node at a cell's centre: numbered after all lattice nodes."""
    return F.col("cell") + (counts[0] + 1) * (counts[1] + 1) * (counts[2] + 1)


def centre_nodes(inside: DataFrame, counts: tuple[int, int, int], h: float) -> DataFrame:
    return inside.select(centre_id(counts).alias("nid"), *[((F.col(n) + 0.5) * h).alias(c) for n, c in zip("ijk", "xyz", strict=True)])


def pyramid_skin(inside: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """(eid, etype, nodes, faces): hexahedra inside; a cell with an open side is six pyramids about its centre."""
    edge = open_sides(inside).select("cell").distinct()
    core = inside.join(edge, "cell", "left_anti").select((F.col("cell") * 6).alias("eid"), *_element("hex8", F.array(*[_corner(n, counts) for n in HEX[0]])))
    own = F.array(*[F.array(*[_corner(n, counts) for n in reversed(corners)], centre_id(counts)) for _, corners in SIDES])  # bases wound towards the centre
    skin = inside.join(edge, "cell", "left_semi").select("cell", F.posexplode(own).alias("s", "n"))
    return core.unionByName(skin.select((F.col("cell") * 6 + F.col("s")).alias("eid"), *_element("pyramid5", F.col("n"))))


def octahedral_fill(inside: DataFrame, counts: tuple[int, int, int]) -> DataFrame:
    """(eid, etype, nodes, faces): tetrahedra about cell centres: four across each inner side, two on each open one."""
    nx, ny, nz = counts
    outer = open_sides(inside)
    all_sides = inside.select("cell", "i", "j", "k", F.explode(F.array(*[F.lit(s) for s in (1, 3, 5)])).alias("side"))
    inner = all_sides.join(outer.filter(F.col("side").isin(1, 3, 5)), ["cell", "i", "j", "k", "side"], "left_anti")
    corners = lambda s: F.array(*[_corner(n, counts) for n in SIDES[s][1]])
    ring = F.when(F.col("side") == 0, corners(0))
    for s in range(1, 6):
        ring = ring.when(F.col("side") == s, corners(s))
    step = F.when(F.col("side") == 1, F.lit(1)).when(F.col("side") == 3, F.lit(nx)).otherwise(F.lit(nx * ny))
    at = lambda q: F.element_at("ring", q % 4 + 1)
    inner = inner.withColumn("ring", ring).withColumn("c", centre_id(counts)).withColumn("d", centre_id(counts) + step)
    four = F.array(*[F.array(F.col("c"), at(q), at(q + 1), F.col("d")) for q in range(4)])
    outer = outer.withColumn("ring", ring).withColumn("c", centre_id(counts))
    two = F.array(F.array(at(0), at(2), at(1), F.col("c")), F.array(at(0), at(3), at(2), F.col("c")))
    eid = ((F.col("cell") * 6 + F.col("side")) * 4 + F.col("t")).alias("eid")
    rows = [df.select("cell", "side", F.posexplode(x).alias("t", "n")).select(eid, *_element("tet4", F.col("n"))) for df, x in ((inner, four), (outer, two))]
    return rows[0].unionByName(rows[1])


def curvature_levels(triangles: DataFrame, counts: tuple[int, int, int], h: float, max_turn: float) -> DataFrame:
    """(i, j, k, level): cells around surface points that turn by more than max_turn (1) or twice that (2) in a cell.

    triangles: tid, ax.., bx.., cx.., ka, kb, kc (curvatures of the corners); they are
    sampled at half a cell, and a sample marks the 27 cells around its own.
    """
    from ..functions.geometry import norm, sub, vec
    from ..operators.spatial import cell, spread

    turn = lambda kappa: 2 * h * kappa  # noqa: E731  the mean curvature is half of what a cylinder bends
    bent = triangles.filter(turn(F.greatest("ka", "kb", "kc")) > max_turn)
    longest = F.greatest(norm(sub(vec("b"), vec("a"))), norm(sub(vec("c"), vec("a"))), norm(sub(vec("c"), vec("b"))))
    n = F.least(F.lit(64), F.greatest(F.lit(1), F.ceil(longest / (0.5 * h)).cast("int")))
    grid = bent.withColumn("n", n).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("u"))))
    fu, fv = F.col("u") / F.col("n"), F.col("v") / F.col("n")
    mixed = lambda a, b, c: fu * F.col(a) + fv * F.col(b) + (1 - fu - fv) * F.col(c)
    points = grid.select(*[mixed(f"a{c}", f"b{c}", f"c{c}").alias(c) for c in "xyz"], turn(mixed("ka", "kb", "kc")).alias("turn")).filter(F.col("turn") > max_turn)
    near = points.select(F.explode(spread(cell(vec(""), h), 1)).alias("c"), F.when(F.col("turn") > 2 * max_turn, 2).otherwise(1).alias("level"))
    inside = [F.col(m).between(0, top - 1) for m, top in zip("ijk", counts, strict=True)]
    return near.select("c.i", "c.j", "c.k", "level").filter(inside[0] & inside[1] & inside[2]).groupBy("i", "j", "k").agg(F.max("level").alias("level"))


def uniform_line(n: int, a: float, b: float) -> list[float]:
    return [a + (b - a) * i / n for i in range(n + 1)]


def graded_line(a: float, b: float, focus: float, first: float, growth: float, layers: int, background: int = 0) -> list[float]:
    """Points of a..b: layers from ``focus`` to both ends, each ``growth`` times the one before, then the rest; and those of a uniform line of ``background`` cells."""
    points = {a, b, focus} | set(uniform_line(background, a, b) if background else ())
    for end in (a, b):
        at, step = 0.0, first
        for _ in range(layers if first > 0 else 0):
            if at + step >= abs(end - focus) - 1e-14:
                break
            at += step
            points.add(focus + at if end > focus else focus - at)
            step *= growth
    out: list[float] = []
    for x in sorted(points):
        if not out or x - out[-1] > 1e-12:
            out.append(x)
    return out


def block_of(spark: SparkSession, xs: list[float], ys: list[float], zs: list[float], keep=None) -> tuple[DataFrame, DataFrame]:
    """(elements, nodes) of a box cut along three lines into tetrahedra, without the cells that ``keep`` (a column over x, y, z of their centre) refuses."""
    counts = (len(xs) - 1, len(ys) - 1, len(zs) - 1)
    line = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    own = cells(spark, counts)
    if keep is not None:
        mid = {c: (line(v, F.col(n)) + line(v, F.col(n) + 1)) / 2 for c, v, n in zip("xyz", (xs, ys, zs), "ijk", strict=True)}
        own = own.withColumns(mid).filter(keep).drop("x", "y", "z")
    grid = lattice_nodes(spark, counts, 1.0)
    nodes = grid.select("nid", *[line(v, F.round(c)).alias(c) for c, v in zip("xyz", (xs, ys, zs), strict=True)])
    elements = fill(own, counts)
    return elements, nodes.join(elements.select(F.explode("nodes").alias("nid")).distinct(), "nid", "left_semi")


def l_domain(spark: SparkSession, n: int, length: float = 1.0, width: float = 0.5, thickness: float = 0.25, graded: tuple[float, float, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(elements, nodes) of an L: the square length x length without the quadrant above ``width`` in x and below it in y.

    ``graded`` (first size, growth, layers) draws the lines towards the inner corner.
    """
    line = lambda: sorted({*uniform_line(n, 0.0, width), *uniform_line(n, width, length)})
    xs = graded_line(0.0, length, width, *graded, background=2 * n) if graded else line()
    zs = uniform_line(max(1, n // 2), 0.0, thickness)
    return block_of(spark, xs, xs, zs, ~((F.col("x") > width) & (F.col("y") < width)))


def box_surface(spark: SparkSession, low: tuple[float, float, float], high: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(triangles: tid, nodes; vertices: vid, x, y, z) of a box, outward."""
    v = [(n, *(float((high if n >> k & 1 else low)[k]) for k in range(3))) for n in range(8)]
    t = [[a, b, c] for _, (a, b, c, _) in SIDES] + [[a, c, d] for _, (a, _, c, d) in SIDES]
    return spark.createDataFrame(list(enumerate(t)), "tid long, nodes array<long>"), spark.createDataFrame(v, "vid long, x double, y double, z double")


def cylinder_surface(spark: SparkSession, radius: float, height: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(triangles, vertices) of an upright cylinder of n sides about the z axis, outward."""
    angle = F.col("id") % n * (2 * 3.141592653589793 / n)
    rim = spark.range(2 * n).select(F.col("id").alias("vid"), (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), F.when(F.col("id") >= n, float(height)).otherwise(0.0).alias("z"))
    caps = spark.createDataFrame([(2 * n, 0.0, 0.0, 0.0), (2 * n + 1, 0.0, 0.0, float(height))], "vid long, x double, y double, z double")
    i, j = F.col("id"), (F.col("id") + 1) % n
    four = F.array(F.array(i, j, j + n), F.array(i, j + n, i + n), F.array(F.lit(2 * n), j, i), F.array(F.lit(2 * n + 1), i + n, j + n))
    return spark.range(n).select(F.col("id"), F.posexplode(four).alias("k", "nodes")).select((F.col("id") * 4 + F.col("k")).alias("tid"), F.col("nodes").cast("array<long>").alias("nodes")), rim.unionByName(caps)


#: Edges of an element, by type: pairs of places in its node list.
TET_EDGES = [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)]
