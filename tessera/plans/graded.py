"""Graded tetrahedral fills: levels of cells from several sources, bisection to those levels, snapping, and collapse of short edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import tet_volume
from ..operators import topology
from ..operators.spatial import stamp
from ..operators.surface import snap, turned
from . import lattice

#: Cells of the coarse lattice at most, and the levels of skin and edges, and of seeds.
MOST_CELLS, EDGE_LEVEL, SEED_LEVEL = 48 * 1024, 1, 2
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def skin_cells(inside: DataFrame, layers: int, save) -> DataFrame:
    """(cell, hops): cells fewer than ``layers`` steps across faces from one with an open side."""
    seeds = lattice.open_sides(inside).select(F.col("cell").alias("node")).distinct()
    links = []
    for n in "ijk":
        after = inside.select(F.col("cell").alias("b"), *[(F.col(m) - int(m == n)).alias(m) for m in "ijk"])
        links.append(inside.join(after, ["i", "j", "k"]).select(F.col("cell").alias("a"), "b"))
    return topology.hops(links[0].unionByName(links[1]).unionByName(links[2]), seeds, save, max(1, layers) - 1).select(F.col("node").alias("cell"), "hops")


def cell_levels(inside: DataFrame, counts: tuple[int, int, int], h: float, save, layers: int = 0, edges: DataFrame | None = None, edge_band: float = 0.0, seeds: DataFrame | None = None, seed_band: float = 0.0, curved: DataFrame | None = None) -> DataFrame:
    """(cell, i, j, k, level): the highest level that any source asks of a cell, else 0.

    Sources: ``layers`` of skin, samples of edges (x, y, z) within ``edge_band`` of a
    cell's centre, seeds (x, y, z) within ``seed_band``, and cells that the surface
    bends in (i, j, k, level).
    """
    asked = []
    if layers > 0:
        asked.append(inside.join(skin_cells(inside, layers, save), "cell").select("i", "j", "k", F.lit(EDGE_LEVEL).alias("level")))
    for points, band, level in ((edges, edge_band, EDGE_LEVEL), (seeds, seed_band, SEED_LEVEL)):
        if points is not None and band > 0:
            asked.append(stamp(points, band, h, counts).select("i", "j", "k", F.lit(level).alias("level")))
    if curved is not None:
        asked.append(curved.select("i", "j", "k", F.col("level").cast("int").alias("level")))
    own = inside.select("cell", "i", "j", "k")
    if not asked:
        return own.withColumn("level", F.lit(0))
    every = asked[0]
    for more in asked[1:]:
        every = every.unionByName(more)
    top = every.groupBy("i", "j", "k").agg(F.max("level").alias("level"))
    return own.join(top, ["i", "j", "k"], "left").select("cell", "i", "j", "k", F.coalesce("level", F.lit(0)).alias("level"))


def bisect_to_levels(elements: DataFrame, nodes: DataFrame, levels: DataFrame, h: float, save) -> tuple[DataFrame, DataFrame]:
    """(elements, nodes): bisected until the longest edge of each tetrahedron is at most a cell's diagonal, halved once for each level of the cell its centroid lies in."""
    levels = save(levels.filter("level > 0").select("i", "j", "k", "level"))
    while True:
        corner = elements.select("eid", F.explode("nodes").alias("nid")).join(nodes, "nid")
        mid = corner.groupBy("eid").agg(*[F.floor(F.avg(c) / h).cast("long").alias(n) for c, n in zip("xyz", "ijk", strict=True)])
        long = topology.longest_edge(elements, nodes, PAIRS).select("eid", "len2")
        most = 3 * h * h * F.pow(F.lit(4.0), -F.col("level")) * (1 + 1e-9)
        marked = save(mid.join(levels, ["i", "j", "k"]).join(long, "eid").filter(F.col("len2") > most).select("eid"))
        if marked.isEmpty():
            return elements, nodes
        elements, nodes = topology.bisect(elements, nodes, marked, save)


def boundary_nodes(elements: DataFrame) -> DataFrame:
    """(nid) of the faces that one tetrahedron alone has."""
    named = elements.select("eid", F.lit("tet4").alias("etype"), "nodes", F.lit(None).cast("array<array<int>>").alias("faces"))
    return topology.boundary_skin(topology.faces(named)).select(F.explode("nodes").alias("nid")).distinct()


def _volume(corners: Column | str) -> Column:
    at = lambda k: tuple(F.element_at(corners, k + 1)[c] for c in "xyz")
    return tet_volume(*[at(k) for k in range(4)])


def collapse(elements: DataFrame, nodes: DataFrame, short: float, save, least: float = 0.0) -> tuple[DataFrame, DataFrame, int]:
    """Takes free nodes out over edges shorter than ``short``: (elements, nodes, how many nodes).

    elements: eid, nodes (tetrahedra); nodes: nid, x, y, z, fixed (the boundary's at
    least).  A free node moves onto the other end of its shortest such edge (the least
    nid on ties) for which every element that remains around it has a volume above
    ``least``.  As the node is inside, the elements around it then fill the same space,
    so all stays conforming.  Each round collapses the edges that are shortest in all
    elements around their nodes: they share no element.  It ends when none is left.
    """
    elements, nodes, taken = save(elements.select("eid", "nodes")), save(nodes.select("nid", "x", "y", "z", "fixed")), 0
    place = nodes.select("nid", F.struct("nid", "x", "y", "z").alias("p"))
    while True:
        at = elements.select("eid", F.posexplode("nodes").alias("n", "nid")).join(place, "nid")
        whole = save(at.groupBy("eid").agg(*[F.max(F.when(F.col("n") == k, F.col("p"))).alias(f"p{k}") for k in range(4)]).select("eid", F.array(*[f"p{k}" for k in range(4)]).alias("corners")))
        corner = lambda k: F.element_at("corners", k + 1)
        ends = F.array(*[F.struct(corner(u).alias("a"), corner(v).alias("b")) for p, q in PAIRS for u, v in ((p, q), (q, p))])
        edge = whole.select(F.explode(ends).alias("e")).select("e.*").withColumn("len2", sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "yz"), (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x"))))
        free = nodes.filter("NOT fixed").select(F.col("nid").alias("gone"))
        wish = edge.filter(F.col("len2") < short * short).select(F.col("a.nid").alias("gone"), F.col("b").alias("stays"), "len2").distinct().join(free, "gone")
        around = whole.select("eid", "corners", F.explode("corners.nid").alias("gone"))
        moved = F.transform("corners", lambda c: F.when(c["nid"] == F.col("gone"), F.col("stays")).otherwise(c))
        lost = F.array_contains("corners.nid", F.col("stays.nid"))
        trial = wish.join(around, "gone").groupBy("gone", "stays", "len2").agg(F.bool_and(lost | (_volume(moved) > least)).alias("fits"))
        best = save(trial.filter("fits").groupBy("gone").agg(F.min(F.struct("len2", F.col("stays.nid").alias("to"), "stays")).alias("m")).select("gone", "m.len2", "m.stays"))
        if best.isEmpty():
            return elements, nodes.select("nid", "x", "y", "z"), taken
        claims = save(around.join(best, "gone").select("eid", "gone", "stays", "len2"))
        first = claims.groupBy("eid").agg(F.min(F.struct("len2", "gone")).alias("f"))
        chosen = claims.join(first, "eid").groupBy("gone").agg(F.bool_and(F.col("f.gone") == F.col("gone")).alias("own"), F.first("stays.nid").alias("to")).filter("own").select("gone", "to")
        chosen = save(chosen)
        taken += chosen.count()
        mine = claims.select("eid", "gone").join(chosen, "gone")
        swapped = elements.join(mine, "eid").filter(~F.array_contains("nodes", F.col("to"))).select("eid", F.transform("nodes", lambda n: F.when(n == F.col("gone"), F.col("to")).otherwise(n)).alias("nodes"))
        elements = save(elements.join(mine.select("eid"), "eid", "left_anti").unionByName(swapped))
        nodes = save(nodes.join(chosen, nodes["nid"] == chosen["gone"], "left_anti"))
        place = nodes.select("nid", F.struct("nid", "x", "y", "z").alias("p"))


def graded_fill(triangles: DataFrame, extent: tuple[float, float, float], h: float, spark: SparkSession, save, snapped: bool = True, short: float = 0.0, **sources) -> tuple[DataFrame, DataFrame, dict]:
    """(elements, nodes, what was done) of a closed surface (tid, ax.., bx.., cx..) whose box starts at the origin.

    Cells inside take their level from ``sources`` (see ``cell_levels``); six
    tetrahedra a cell are bisected to it.  Then boundary nodes go onto the surface, as
    far as no element turns, and inner edges shorter than ``short`` times the finest
    size are collapsed.
    """
    counts, h = lattice.fit_counts(extent, h, MOST_CELLS)
    inside = save(lattice.classify(triangles, counts, h, spark))
    levels = save(cell_levels(inside, counts, h, save, **sources))
    elements = save(lattice.fill(inside, counts).select("eid", "nodes"))
    nodes = save(lattice.lattice_nodes(spark, counts, h).join(elements.select(F.explode("nodes").alias("nid")).distinct(), "nid", "left_semi"))
    elements, nodes = bisect_to_levels(elements, nodes, levels, h, save)
    row = levels.agg(F.max("level").alias("top"), *[F.count_if(F.col("level") == k).alias(f"n{k}") for k in range(3)]).first()
    done = {"h": h, "h_fine": h / 2 ** (row["top"] or 0), "cells": [row[f"n{k}"] for k in range(3)], "moved": 0, "taken_back": 0, "collapsed": 0}
    edge = save(boundary_nodes(elements))
    if snapped:
        inner = save(nodes.join(edge, "nid", "left_anti"))
        wrong = turned(elements)
        outer, counted = snap(nodes.join(edge, "nid", "left_semi"), triangles, done["h_fine"], lambda n: wrong(inner.unionByName(n)), elements.select("eid", F.explode("nodes").alias("nid")), save)
        nodes = save(inner.unionByName(outer))
        done["moved"], done["taken_back"] = counted.first()
    if short > 0:
        marked = nodes.join(edge.withColumn("fixed", F.lit(True)), "nid", "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
        elements, nodes, done["collapsed"] = collapse(elements, nodes=marked, short=short * done["h_fine"], save=save)
    return elements, nodes, done
