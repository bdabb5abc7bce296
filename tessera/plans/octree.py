"""Linear octrees: refinement to wanted sizes, 2:1 balance, conforming transition elements.

An octree is two relations.  ``inner`` holds the nodes (level, i, j, k) that are split,
``leaves`` the cells that aren't; a cell of level l has the edge h / 2^l and lies at
(i, j, k) times that.  Level 0 is a lattice of ``counts`` cells.  Leaves carry the
Morton code of their lower corner, their number and their order along a curve that
keeps neighbours together.

* A wish for a leaf of level l splits its ancestors: one explode, no iteration.
* 2:1 balance (across faces, edges and corners): where a node is split, all 26
  neighbours of its level must exist, so their parents are split.  The rule only ever
  asks for coarser nodes, so one sweep from the finest level to the coarsest reaches
  the fixpoint; the result is the smallest balanced refinement.
* A leaf beside split nodes has hanging nodes on its faces and edges.  It becomes
  pyramids and tetrahedra about its centre: a face beside a split node counts as its
  four quarters, a face with hanging edge nodes as triangles about the face's centre,
  any other as one quadrilateral.  What a face looks like depends on the nodes around
  it alone, so both its sides agree.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lattice import SIDES, cells

#: Bits of a coordinate on the finest lattice; three of them and a local number fit a long.
MOST_BITS = 18
_AT = ["level", "i", "j", "k"]
_LOCAL = 128


def _xyz(corner: int) -> tuple[int, int, int]:
    return corner & 1, corner >> 1 & 1, corner >> 2


_EDGES = [(a, b) for a, b in combinations(range(8), 2) if (a ^ b).bit_count() == 1]
_EDGE_BIT = {frozenset(e): 6 + n for n, e in enumerate(_EDGES)}
_SIDE_EDGES = [[frozenset(x) for x in zip(c, (*c[1:], c[0]), strict=True)] for _, c in SIDES]


def _marks() -> list[tuple[tuple[int, int, int], int]]:
    """For each of the 18 neighbours across a face or an edge: the bits of what its being split does to a cell.  Bits 0 to 5: sides in quarters; 6 to 17: edges with a node."""
    out = []
    for s, (step, _) in enumerate(SIDES):
        out.append((step, 1 << s | sum(1 << _EDGE_BIT[e] for e in _SIDE_EDGES[s])))
    for e in _EDGES:
        a, b = map(_xyz, e)
        out.append((tuple(0 if p != q else 2 * p - 1 for p, q in zip(a, b, strict=True)), 1 << _EDGE_BIT[frozenset(e)]))
    return out


def _templates() -> list[tuple[int, int, int, str, list[tuple[int, int, int]]]]:
    """(bits that must be set, must not, one of which must, kind, corners in half edges) of all elements a transition cell may have."""
    out = []
    middle = lambda *p: tuple(2 * sum(x) // len(p) for x in zip(*map(_xyz, p), strict=True))
    whole = lambda c: tuple(2 * x for x in _xyz(c))
    centre = (1, 1, 1)
    for s, (_, c) in enumerate(SIDES):
        ring = list(zip(c, (*c[1:], c[0]), strict=True))
        hung = sum(1 << _EDGE_BIT[e] for e in _SIDE_EDGES[s])
        face = middle(*c)
        out.append((0, 1 << s | hung, -1, "pyramid5", [*map(whole, reversed(c)), centre]))
        for n in range(4):  # bases wound towards the centre
            out.append((1 << s, 0, -1, "pyramid5", [middle(c[n - 1], c[n]), face, middle(*ring[n]), whole(c[n]), centre]))
        for a, b in ring:
            bit, m = 1 << _EDGE_BIT[frozenset((a, b))], middle(a, b)
            out.append((0, 1 << s | bit, hung, "tet4", [whole(b), whole(a), face, centre]))
            out += [(bit, 1 << s, hung, "tet4", [m, whole(a), face, centre]), (bit, 1 << s, hung, "tet4", [whole(b), m, face, centre])]
    return out


def _apart(x: Column) -> Column:
    """A coordinate's bits with two zeros between each."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(depth: int, bit=_apart) -> Column:
    """The Morton code of a cell's lower corner on the lattice of level ``depth``."""
    x, y, z = (bit(F.expr(f"shiftleft({c}, {depth} - level)")) for c in "ijk")
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def _check(counts: tuple[int, int, int], depth: int) -> None:
    if max(counts) << depth >= 1 << MOST_BITS:
        raise ValueError(f"the finest lattice has 2^{MOST_BITS} cells or more along an axis")


def _inside_box(counts: tuple[int, int, int]) -> Column:
    ok = F.lit(True)
    for c, n in zip("ijk", counts, strict=True):
        ok = ok & F.expr(f"{c} >= 0 AND {c} < shiftleft({n}L, level)")
    return ok


def level_of_size(size: Column, h: float, depth: int) -> Column:
    """The coarsest level whose cells are no larger than ``size``, ``depth`` at most."""
    return F.greatest(F.lit(0), F.least(F.lit(depth), F.ceil(F.log2(h / size) - 1e-12).cast("int")))


def wanted(points: DataFrame, h: float, counts: tuple[int, int, int]) -> DataFrame:
    """The nodes to split so that each point (x, y, z, level) lies in a leaf of its level or finer.  Points outside the box ask for nothing."""
    above = points.filter("level > 0").select("x", "y", "z", F.explode(F.sequence(F.lit(0), F.col("level").cast("int") - 1)).alias("level"))
    at = above.select("level", *[F.floor(F.col(c) / h * F.pow(F.lit(2.0), F.col("level"))).cast("long").alias(n) for c, n in zip("xyz", "ijk", strict=True)])
    return at.distinct().filter(_inside_box(counts))


def balance(split: DataFrame, counts: tuple[int, int, int], depth: int, save) -> DataFrame:
    """The least set of split nodes that holds ``split`` and has no neighbours two levels apart.  Leaves are of level ``depth`` at most."""
    _check(counts, depth)
    split, done, more = save(split.select(*_AT)), None, None
    for level in range(depth - 1, -1, -1):
        own = split.filter(F.col("level") == level)
        own = save((own if more is None else own.unionByName(more)).distinct())
        done = own if done is None else done.unionByName(own)
        if level:
            # of a node's neighbours along an axis, one has the same parent
            for c in "ijk":
                up = F.shiftright(c, 1)
                own = own.withColumn(c, F.explode(F.array(up, up + F.when(F.col(c) % 2 == 1, 1).otherwise(-1))))
            more = own.withColumn("level", F.lit(level - 1)).filter(_inside_box(counts))
    return done


def leaves(spark: SparkSession, inner: DataFrame, counts: tuple[int, int, int], depth: int) -> DataFrame:
    """(code, level, i, j, k): the cells that aren't split, of the whole box."""
    _check(counts, depth)
    ground = cells(spark, counts).select(F.lit(0).alias("level"), "i", "j", "k")
    children = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in product((0, 1), repeat=3)])).alias("o")
    below = inner.select("*", children).select((F.col("level") + 1).alias("level"), *[(2 * F.col(c) + F.col(f"o.{o}")).alias(c) for c, o in zip("ijk", "xyz", strict=True)])
    return ground.unionByName(below).join(inner, _AT, "left_anti").select(morton(depth).alias("code"), *_AT)


def carve(own: DataFrame, triangles: DataFrame, h: float, depth: int) -> DataFrame:
    """The leaves whose centre lies inside a closed surface (ax .. cz), by parity along their column."""
    from ..operators.ordered import parity_inside
    from ..operators.spatial import columns_under

    cross = None
    for level in range(depth + 1):
        found = columns_under(triangles, h / 2**level).select(F.struct(F.lit(level).alias("level"), "i", "j").alias("column"), "z")
        cross = found if cross is None else cross.unionByName(found)
    points = own.withColumn("column", F.struct("level", "i", "j")).withColumn("cz", (F.col("k") + 0.5) * h / F.pow(F.lit(2.0), F.col("level")))
    return parity_inside(cross, points, "column", "z", "cz").filter("inside").select("code", *_AT)


def transitions(own: DataFrame, inner: DataFrame) -> DataFrame:
    """The leaves with ``marks``: which of their sides are in quarters and which edges have a node (see _marks)."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)], F.lit(bits).alias("bits")) for o, bits in _marks()])).alias("o")
    met = inner.select("*", steps).select("level", *[(F.col(c) - F.col(f"o.{o}")).alias(c) for c, o in zip("ijk", "xyz", strict=True)], F.col("o.bits").alias("bits"))
    return own.join(met.groupBy(*_AT).agg(F.bit_or("bits").alias("marks")), _AT, "left").select("code", *_AT, F.coalesce("marks", F.lit(0)).alias("marks"))


def _node(offset: list[Column], counts: tuple[int, int, int], depth: int) -> Column:
    """A node's number: its place on the lattice of half the finest edge."""
    wide, deep = (2 * n * 2**depth + 1 for n in counts[:2])
    x, y, z = (F.expr(f"shiftleft({c}, {depth} + 1 - level)") + o * F.expr(f"shiftleft(1L, {depth} - level)") for c, o in zip("ijk", offset, strict=True))
    return (z * deep + y) * wide + x


def elements(marked: DataFrame, counts: tuple[int, int, int], depth: int, hexes: bool = True) -> DataFrame:
    """(eid, etype, nodes, faces) of marked leaves.  Without ``hexes`` every cell is cut about its centre."""
    nodes = lambda offsets: F.array(*[_node([F.lit(x) for x in o], counts, depth) for o in offsets])
    none = F.lit(None).cast("array<array<int>>").alias("faces")
    cube = [tuple(2 * x for x in _xyz(c)) for c in (0, 1, 3, 2, 4, 5, 7, 6)]
    plain = marked.filter("marks = 0").select((F.col("code") * _LOCAL).alias("eid"), F.lit("hex8").alias("etype"), nodes(cube).alias("nodes"), none)
    kinds = F.array(*[F.struct(F.lit(must).alias("must"), F.lit(never).alias("never"), F.lit(some).alias("some"), F.lit(kind).alias("etype"), F.array(*[F.lit(9 * x + 3 * y + z) for x, y, z in offsets]).alias("at")) for must, never, some, kind, offsets in _templates()])
    cut = (marked.filter("marks <> 0") if hexes else marked).select("*", F.posexplode(kinds).alias("n", "t"))
    cut = cut.filter("marks & t.must = t.must AND marks & t.never = 0 AND (t.some < 0 OR marks & t.some <> 0)")
    place = lambda p: _node([F.expr(f"{p} div {d} % 3") for d in (9, 3, 1)], counts, depth)
    corner = [place(f"t.at[{n}]") for n in range(5)]
    corners = F.when(F.col("t.etype") == "tet4", F.array(*corner[:4])).otherwise(F.array(*corner))
    cut = cut.select((F.col("code") * _LOCAL + F.col("n")).alias("eid"), F.col("t.etype").alias("etype"), corners.alias("nodes"), none)
    return plain.unionByName(cut) if hexes else cut


def nodes_of(own: DataFrame, h: float, counts: tuple[int, int, int], depth: int) -> DataFrame:
    """(nid, x, y, z) of the nodes that elements use."""
    wide, deep = (2 * n * 2**depth + 1 for n in counts[:2])
    unit, nid = h / 2 ** (depth + 1), F.col("nid")
    used = own.select(F.explode("nodes").alias("nid")).distinct()
    return used.select("nid", (nid % wide * unit).alias("x"), (F.floor(nid / wide) % deep * unit).alias("y"), (F.floor(nid / (wide * deep)) * unit).alias("z"))
