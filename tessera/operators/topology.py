"""Mesh topology as relations: faces, edges, welding, compaction, regions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def _opposite(i: int) -> tuple[int, int, int]:
    """The face of a tetrahedron opposite node i, outward."""
    a, b, c = (n for n in range(4) if n != i)
    return (a, c, b) if i % 2 else (a, b, c)


#: Local faces of each element type, as places in its node list (outward; a pyramid's base as its nodes run).
FACES = {
    "tet4": [_opposite(i) for i in range(4)],
    "hex8": [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)],
    "prism6": [(0, 2, 1), (3, 4, 5), (0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5)],
    "pyramid5": [(0, 1, 2, 3), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)],
}
#: Corner nodes of the quadratic types, which have the faces of their linear ones.
LINEAR = {"tet10": "tet4", "hex20": "hex8"}
#: Nodes of each type.
ARITY = {"tet4": 4, "tet10": 10, "hex8": 8, "hex20": 20, "prism6": 6, "pyramid5": 5}


def faces(elements: DataFrame) -> DataFrame:
    """One row for each element face: eid, local face, nodes in the element's orientation.

    elements: eid, etype, nodes, faces (local faces of polyhedra, else null).
    """
    pick = lambda places: F.array(*[F.element_at("nodes", p + 1) for p in places])
    out = None
    for etype, own in FACES.items():
        names = [etype, *[k for k, v in LINEAR.items() if v == etype]]
        value = F.array(*[pick(f) for f in own])
        out = F.when(F.col("etype").isin(*names), value) if out is None else out.when(F.col("etype").isin(*names), value)
    poly = F.transform(F.col("faces"), lambda f: F.transform(f, lambda p: F.element_at("nodes", p + 1)))
    return elements.select("eid", F.posexplode(out.otherwise(poly)).alias("local", "nodes"))


def face_key(nodes: Column) -> Column:
    """The sorted distinct nodes: equal for all orientations of a face."""
    return F.array_sort(F.array_distinct(nodes))


def face_classes(faces: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Per canonical face how many elements share it (map-side counted)."""
    return faces.groupBy(face_key(F.col(nodes)).alias("face")).agg(F.count("*").alias("n"))


def conformity(classes: DataFrame) -> DataFrame:
    """One row: boundary (1), interior (2), non-conforming (3 or more) faces, and whether there is none of the last."""
    out = classes.agg(F.count_if(F.col("n") == 1).alias("n_boundary"), F.count_if(F.col("n") == 2).alias("n_interior"), F.count_if(F.col("n") > 2).alias("n_nonconforming"))
    return out.withColumn("conforming", F.col("n_nonconforming") == 0)


def boundary_skin(faces: DataFrame) -> DataFrame:
    """Faces of one element only, in the orientation of their least (eid, local); triangles as quads with the last node repeated.

    Faces of three or four nodes count; triangles with a repeated corner have collapsed and don't.
    """
    n = F.size("nodes")
    faces = faces.filter((n == 4) | (n == 3) & (F.size(F.array_distinct("nodes")) == 3))
    out = faces.groupBy(face_key(F.col("nodes")).alias("face")).agg(F.count("*").alias("n"), F.min(F.struct("eid", "local", "nodes")).alias("first"))
    quad = F.when(F.size("first.nodes") == 3, F.concat("first.nodes", F.slice("first.nodes", 3, 1))).otherwise(F.col("first.nodes"))
    return out.filter("n = 1").select(F.col("first.eid").alias("eid"), F.col("first.local").alias("local"), F.col("first.nodes").alias("nodes"), quad.alias("quad"))


def boundary_polygons(faces: DataFrame) -> DataFrame:
    """Faces of one element only with any number of nodes, by their distinct nodes, in the orientation of their least (eid, local)."""
    out = faces.filter(F.size(F.array_distinct("nodes")) >= 3).groupBy(face_key(F.col("nodes")).alias("face")).agg(F.count("*").alias("n"), F.min(F.struct("eid", "local", "nodes")).alias("first"))
    return out.filter("n = 1").select("first.eid", "first.local", "first.nodes")


def skin_edges(elements: DataFrame) -> DataFrame:
    """(a, b): edges of the boundary where elements tell their kind only by how many nodes they have: 4, 5, 6 or 8; any other is one face."""
    kind = F.create_map(*[F.lit(x) for n, t in ((4, "tet4"), (5, "pyramid5"), (6, "prism6"), (8, "hex8")) for x in (n, t)])
    named = elements.select("eid", F.coalesce(F.element_at(kind, F.size("nodes")), F.lit("poly")).alias("etype"), "nodes", F.array(F.sequence(F.lit(0), F.size("nodes") - 1)).alias("faces"))
    return edges(boundary_polygons(faces(named)), ["eid"]).select("a", "b").distinct()


def hanging_faces(skin: DataFrame, nodes: DataFrame, margin: float) -> DataFrame:
    """Skin faces whose centroid lies further than ``margin`` inside the bounding box: holes in a box mesh."""
    corner = skin.select("eid", "local", F.explode("nodes").alias("nid")).join(nodes, "nid")
    mid = corner.groupBy("eid", "local").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    box = nodes.agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("0", F.min), ("1", F.max))])  # one row
    far = lambda c: F.least(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(c)) > margin
    return mid.crossJoin(F.broadcast(box)).filter(far("x") & far("y") & far("z")).select("eid", "local")


def edges(polygons: DataFrame, key: list[str], nodes: str = "nodes") -> DataFrame:
    """The undirected edges of each polygon: key columns, a < b, and whether it runs from a to b."""
    n = F.size(nodes)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(nodes, i).alias("p"), F.element_at(nodes, i % n + 1).alias("q")))
    out = polygons.select(*key, F.explode(pairs).alias("e"))
    return out.select(*key, F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b"), (F.col("e.p") < F.col("e.q")).alias("forward"))


def open_edges(polygons: DataFrame, key: list[str]) -> DataFrame:
    """Edges that don't belong to exactly two polygons: none on a closed manifold."""
    return edges(polygons, key).groupBy("a", "b").agg(F.count("*").alias("n")).filter("n <> 2")


def weld(points: DataFrame, coords: list[str], position: str, decimals: int | None = None, exact_bits: bool = False) -> DataFrame:
    """Distinct points with dense ids from 0 in the order of their first position, and each point's id.

    By value, by rounded value, or by bit pattern (-0.0 apart from 0.0).  Ids are
    counted block-wise over first positions.
    """
    from .ordered import ranked

    key = [F.round(c, decimals) if decimals is not None else F.hex(F.encode(F.col(c).cast("string"), "utf-8")) if exact_bits else F.col(c) for c in coords]
    df = points.withColumns({f"_k{i}": k for i, k in enumerate(key)})
    names = [f"_k{i}" for i in range(len(coords))]
    first = df.groupBy(*names).agg(F.min(position).alias("first_position"), F.count("*").alias("n_points"))
    first = ranked(first, "first_position", [], "weld_id", descending=False).withColumn("weld_id", F.col("weld_id") - 1)
    return df.join(first, names).drop(*names)


def polyhedra(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(eid, volume, cx, cy, cz) of polyhedra by the divergence theorem; elements: eid, etype, nodes, faces."""
    at = lambda name: nodes.select(F.col("nid").alias(name), *[F.col(c).alias(f"{name}{c}") for c in "xyz"])
    mean = elements.select("eid", F.explode("nodes").alias("nid")).join(nodes, "nid").groupBy("eid").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    rim = faces(elements).filter(F.size("nodes") >= 3)
    n = F.size("nodes")
    walk = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.element_at("nodes", i).alias("p"), F.element_at("nodes", i % n + 1).alias("q")))
    steps = rim.select("eid", "local", F.element_at("nodes", 1).alias("o"), n.alias("n"), F.explode(walk).alias("w")).select("eid", "local", "o", "n", "w.*")
    steps = steps.join(at("p"), "p").join(at("q"), "q").join(at("o"), "o").join(mean, "eid")
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    p, q, o, m = (tuple(F.col(f"{k}{c}") for c in "xyz") for k in ("p", "q", "o", "m"))
    area = cross(p, q)
    less = lambda u, v: tuple(a - b for a, b in zip(u, v, strict=True))
    fan = cross(less(p, m), less(q, m))
    six = sum((a * b for a, b in zip(less(o, m)[1:], fan[1:], strict=True)), less(o, m)[0] * fan[0])
    moment = [F.sum(six / 6 * (m[k] + o[k] + p[k] + q[k]) / 4).alias(f"t{c}") for k, c in enumerate("xyz")]
    by_face = steps.groupBy("eid", "local").agg(*[F.sum(area[k] / 2).alias(f"a{c}") for k, c in enumerate("xyz")], *[F.avg(p[k]).alias(f"f{c}") for k, c in enumerate("xyz")], F.sum(six / 6).alias("v"), *moment)
    share = (F.col("fx") * F.col("ax") + F.col("fy") * F.col("ay") + F.col("fz") * F.col("az")) / 3
    own = by_face.groupBy("eid").agg(F.sum(share).alias("volume"), F.sum("v").alias("v"), *[F.sum(f"t{c}").alias(f"t{c}") for c in "xyz"]).join(mean, "eid")
    return own.select("eid", "volume", *[F.when(F.abs("v") < 1e-30, F.col(f"m{c}")).otherwise(F.col(f"t{c}") / F.col("v")).alias(f"c{c}") for c in "xyz"])


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a dense id from 0 in the order of a distinct key."""
    from .ordered import ranked

    return ranked(df, key, [], name, descending=False).withColumn(name, F.col(name) - 1)


def compact(nodes: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops unused nodes and renumbers: (nodes with new ids, elements over them)."""
    flat = elements.select("eid", F.posexplode("nodes").alias("pos", "nid"))
    used = dense_ids(nodes.join(flat.select("nid").distinct(), "nid", "left_semi"), "nid", "new_id")
    back = flat.join(used.select("nid", "new_id"), "nid").groupBy("eid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new_id"))), lambda s: s["new_id"]).alias("nodes"))
    return used.drop("nid").withColumnRenamed("new_id", "nid"), elements.drop("nodes").join(back, "eid")


def midpoints(elements: DataFrame, nodes: DataFrame, pairs: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """A node at the middle of each distinct element edge: (all nodes, elements with the new ids appended)."""
    ends = F.array(*[F.struct(F.least(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("a"), F.greatest(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("b")) for p, q in pairs])
    flat = elements.select("eid", F.posexplode(ends).alias("pos", "e")).select("eid", "pos", "e.a", "e.b")
    top = nodes.agg(F.max("nid")).first()[0]
    new = dense_ids(flat.groupBy("a", "b").agg(F.min(F.col("eid") * len(pairs) + F.col("pos")).alias("first")), "first", "k").withColumn("nid", F.col("k") + top + 1)
    at = new.join(nodes.select(F.col("nid").alias("a"), *[F.col(c).alias(f"{c}a") for c in "xyz"]), "a").join(nodes.select(F.col("nid").alias("b"), *[F.col(c).alias(f"{c}b") for c in "xyz"]), "b")
    added = at.select("nid", *[((F.col(f"{c}a") + F.col(f"{c}b")) / 2).alias(c) for c in "xyz"])
    extra = flat.join(new.select("a", "b", "nid"), ["a", "b"]).groupBy("eid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "nid"))), lambda s: s["nid"]).alias("extra"))
    return nodes.select("nid", "x", "y", "z").unionByName(added), elements.join(extra, "eid").withColumn("nodes", F.concat("nodes", "extra")).drop("extra")


def orphans(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes of no element."""
    return nodes.join(elements.select(F.explode("nodes").alias("nid")).distinct(), "nid", "left_anti")


def incidence(elements: DataFrame) -> DataFrame:
    """node to element pairs."""
    return elements.select("eid", F.explode("nodes").alias("nid"))


def remap(elements: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements over dense ids (ids: old, new), and the references that name no node."""
    flat = elements.select("eid", F.posexplode("nodes").alias("pos", "old"))
    missing = flat.join(ids, "old", "left_anti").select("eid", "old")
    ok = flat.join(ids, "old").groupBy("eid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]).alias("nodes"))
    return elements.drop("nodes").join(ok, "eid"), missing


def violations(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(eid, problem): wrong arity, repeated nodes, references to no node."""
    arity = F.element_at(F.create_map(*[F.lit(x) for kv in ARITY.items() for x in kv]), F.col("etype"))
    own = elements.select("eid", F.when(arity.isNotNull() & (F.size("nodes") != arity), "arity").when(F.size(F.array_distinct("nodes")) < F.size("nodes"), "repeated node").alias("problem")).filter("problem is not null")
    lost = incidence(elements).join(nodes.select("nid"), "nid", "left_anti").select("eid", F.lit("unknown node").alias("problem")).distinct()
    return own.unionByName(lost)


def face_pairs(faces: DataFrame) -> DataFrame:
    """Neighbouring elements: pairs that share a canonical face (at most the sharers of one face)."""
    keyed = faces.select("eid", face_key(F.col("nodes")).alias("face"))
    shared = keyed.groupBy("face").agg(F.min("eid").alias("a"), F.max("eid").alias("b"), F.count("*").alias("n"))
    return shared.filter("n = 2").select("a", "b")


def pair_by_centroid(faces: DataFrame, eps: float) -> DataFrame:
    """Second pass: single faces paired by their rounded centroid (x, y, z)."""
    key = [F.floor(F.col(c) / eps + 0.5).alias(f"q{c}") for c in "xyz"]
    found = faces.select("fid", *key).groupBy("qx", "qy", "qz").agg(F.count("*").alias("n"), F.min("fid").alias("a"), F.max("fid").alias("b"))
    return found.filter("n = 2").select("a", "b")


#: Links that one task may hold.
ONE_TASK = 500_000


def _joined_up(batches):
    """(node, label) from all links (a, b): each tree of nodes points at its least one."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "label"])


def components(links: DataFrame, nodes: DataFrame, save) -> DataFrame:
    """(node, label): the least node reachable over links (a, b).  ``save`` writes a frame and reads it again.

    Min-label propagation with pointer jumping: each round takes the least label
    around a node, then that label's own label.  At most ``ONE_TASK`` links (a count
    decides) are joined up in one task instead.
    """
    both = save(links.select("a", "b").union(links.select("b", "a")).distinct())
    if both.limit(ONE_TASK + 1).count() <= ONE_TASK:
        found = both.coalesce(1).mapInArrow(_joined_up, "node long, label long")
        return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = save(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        own = labels.select(F.col("node").alias("n2"), F.col("label").alias("jump"))
        step = save(step.join(own, step.next == own.n2, "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("jump", "next")).alias("label")))
        labels = step.select("node", "label")
        if not step.filter("label < was").limit(1).count():
            return labels


def regions(labels: DataFrame) -> DataFrame:
    """Region numbers from 0 in the order of each region's least node."""
    from .ordered import ranked

    own = ranked(labels.select("label").distinct(), "label", [], "region", descending=False)
    return labels.join(own, "label").select("node", (F.col("region") - 1).alias("region"))


def hops(links: DataFrame, seeds: DataFrame, save, most: int | None = None) -> DataFrame:
    """(node, hops): breadth-first distance from the seeds, one frontier join a round.

    Rounds run until no node is new; ``most`` asks for the nodes within so many hops only.
    """
    both = save(links.select("a", "b").union(links.select("b", "a")).distinct())
    done = save(seeds.select("node", F.lit(0).alias("hops")).distinct())
    for d in itertools.count(1) if most is None else range(1, most + 1):
        front = both.join(done.filter(F.col("hops") == d - 1), F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct()
        new = front.join(done, "node", "left_anti").withColumn("hops", F.lit(d))
        new = save(new)
        if not new.limit(1).count():
            break
        done = save(done.unionByName(new))
    return done


def element_type_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("etype").agg(F.count("*").alias("n"))


def sharp_edges(triangles: DataFrame, degrees: float) -> DataFrame:
    """Boundary edges and those whose two normals differ by more than the angle; edges of three or more triangles are left out.

    triangles: tid, nodes (3), nx, ny, nz (unit normal).
    """
    e = edges(triangles, ["tid", "nx", "ny", "nz"])
    g = e.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("tid", "nx", "ny", "nz")).alias("p"), F.max(F.struct("tid", "nx", "ny", "nz")).alias("q"))
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sum((F.col(f"p.n{c}") * F.col(f"q.n{c}") for c in "yz"), F.col("p.nx") * F.col("q.nx"))))
    angle = F.when(F.col("n") == 1, F.lit(None).cast("double")).otherwise(F.acos(dot))
    return g.filter("n <= 2").withColumn("dihedral", angle).filter((F.col("n") == 1) | (F.col("dihedral") > F.radians(F.lit(degrees)))).select("a", "b", "n", "dihedral")


def smooth_links(triangles: DataFrame, degrees: float) -> DataFrame:
    """Triangle pairs across an edge of two whose normals agree within the angle (regions grow over these)."""
    e = edges(triangles, ["tid", "nx", "ny", "nz"])
    g = e.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("tid", "nx", "ny", "nz")).alias("p"), F.max(F.struct("tid", "nx", "ny", "nz")).alias("q"))
    dot = sum((F.col(f"p.n{c}") * F.col(f"q.n{c}") for c in "yz"), F.col("p.nx") * F.col("q.nx"))
    return g.filter("n = 2").filter(dot > F.cos(F.radians(F.lit(degrees)))).select(F.col("p.tid").alias("a"), F.col("q.tid").alias("b"))


def edge_classes(edges: DataFrame, flat_degrees: float = 25.0) -> DataFrame:
    """seam (one face twice), smooth or sharp by the angle between normals; an open edge is sharp."""
    dot = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot")))
    return edges.withColumn("feature", F.when(F.col("f1") == F.col("f2"), "seam").when(F.col("f2").isNull(), "sharp").when(F.acos(dot) > F.radians(F.lit(flat_degrees)), "sharp").otherwise("smooth"))


def numbered_once(df: DataFrame, part: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a number from 0 inside each part."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)


def longest_edge(elements: DataFrame, nodes: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(eid, a, b, len2): each element's longest edge, the least (a, b) on ties."""
    ends = F.array(*[F.struct(F.least(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("a"), F.greatest(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("b")) for p, q in pairs])
    flat = elements.select("eid", F.explode(ends).alias("e")).select("eid", "e.a", "e.b")
    for n in "ab":
        flat = flat.join(nodes.select(F.col("nid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), n)
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    flat = flat.withColumn("len2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return flat.groupBy("eid").agg(F.min(F.struct((-F.col("len2")).alias("m"), "a", "b")).alias("s")).select("eid", "s.a", "s.b", (-F.col("s.m")).alias("len2"))


def bisection_closure(elements: DataFrame, nodes: DataFrame, marked: DataFrame, pairs: list[tuple[int, int]], save) -> DataFrame:
    """(eid): the marked elements and all whose edges they split, to the fixpoint.

    Each round splits the longest edge of every element marked so far; elements that
    hold a split edge are marked in the next.
    """
    longest = save(longest_edge(elements, nodes, pairs))
    ends = F.array(*[F.struct(F.least(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("a"), F.greatest(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("b")) for p, q in pairs])
    holds = save(elements.select("eid", F.explode(ends).alias("e")).select("eid", "e.a", "e.b"))
    done = save(marked.select("eid").distinct())
    while True:
        split = longest.join(done, "eid", "left_semi").select("a", "b").distinct()
        more = save(holds.join(split, ["a", "b"], "left_semi").select("eid").distinct().join(done, "eid", "left_anti"))
        if not more.limit(1).count():
            return done
        done = save(done.unionByName(more))


def capped(df: DataFrame, lead: str, ties: list[str], share: float, least: int = 8, descending: bool = False) -> DataFrame:
    """The first share of the rows in an order, at least ``least``: a stated limit of the refinement plan."""
    from .ordered import first_share

    return first_share(df, lead, ties, share, least, descending, up=False)


def feature_counts(edges: DataFrame) -> DataFrame:
    """One row: sharp, smooth and seam edges."""
    return edges.agg(*[F.count_if(F.col("feature") == k).alias(f"n_{k}") for k in ("sharp", "smooth", "seam")])


def weld_within(points: DataFrame, position: str, share: float = 1e-10) -> DataFrame:
    """As ``weld`` over x, y, z, on a grid whose step is a share of the bounding box's diagonal."""
    ends = points.agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("0", F.min), ("1", F.max))]).first()
    diagonal = sum(((ends[f"{c}1"] or 0.0) - (ends[f"{c}0"] or 0.0)) ** 2 for c in "xyz") ** 0.5
    step = share * diagonal or share
    keyed = points.withColumns({f"_q{c}": F.floor(F.col(c) / step + 0.5) for c in "xyz"})
    return weld(keyed, [f"_q{c}" for c in "xyz"], position).drop("_qx", "_qy", "_qz")


def focused(marked: DataFrame, focus: DataFrame, key: str = "eid") -> DataFrame:
    """The marked rows that are in focus; all of them where none is."""
    found = marked.join(focus.select(key).distinct(), key, "left_semi")
    return found if found.limit(1).count() else marked


def without_points(points: DataFrame, others: DataFrame, decimals: int = 6) -> DataFrame:
    """Points that none of the others equals by rounded coordinates."""
    key = [F.round(F.col(c), decimals).alias(f"_r{c}") for c in "xyz"]
    mine = points.withColumns({f"_r{c}": F.round(F.col(c), decimals) for c in "xyz"})
    return mine.join(others.select(*key).distinct(), ["_rx", "_ry", "_rz"], "left_anti").drop("_rx", "_ry", "_rz")


def bisect(elements: DataFrame, nodes: DataFrame, marked: DataFrame, save) -> tuple[DataFrame, DataFrame]:
    """Longest-edge bisection of tetrahedra (eid, nodes) until every marked one is split and no edge hangs: (elements, nodes).

    Every round splits, all at once, the edges that are the longest of each element
    around them; no element has two such edges.  Elements whose longest edge is not
    yet one wait, and their neighbours over it join the queue.  The first child keeps
    its parent's id.
    """
    from .ordered import dense_ids_from

    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    elements, nodes, queue = save(elements.select("eid", "nodes")), save(nodes.select("nid", "x", "y", "z")), save(marked.select("eid").distinct())
    goal = queue
    ends = F.array(*[F.struct(F.least(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("a"), F.greatest(F.element_at("nodes", p + 1), F.element_at("nodes", q + 1)).alias("b")) for p, q in pairs])
    while goal.limit(1).count():
        longest = save(longest_edge(elements, nodes, pairs).select("eid", "a", "b"))
        holds = save(elements.select("eid", F.explode(ends).alias("e")).select("eid", "e.a", "e.b"))
        while True:  # neighbours over a waiting element's longest edge wait, too
            wanted = longest.join(queue, "eid", "left_semi").select("a", "b").distinct()
            more = save(holds.join(wanted, ["a", "b"], "left_semi").select("eid").distinct().join(queue, "eid", "left_anti"))
            if not more.limit(1).count():
                break
            queue = save(queue.unionByName(more))
        around = holds.join(wanted, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n"))
        ready = longest.groupBy("a", "b").agg(F.count("*").alias("m")).join(around, ["a", "b"]).filter("n = m").select("a", "b")
        new = save(dense_ids_from(ready, ["a", "b"], "nid", nodes.agg(F.max("nid")).first()[0] + 1))
        split = save(longest.join(new, ["a", "b"]).select("eid", "a", "b", F.col("nid").alias("mid")))
        second = save(dense_ids_from(split.select("eid"), ["eid"], "child", elements.agg(F.max("eid")).first()[0] + 1))
        at = new.join(nodes.select(F.col("nid").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"]), "a").join(nodes.select(F.col("nid").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"]), "b")
        nodes = save(nodes.unionByName(at.select("nid", *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"])))
        both = elements.join(split, "eid").join(second, "eid")
        swap = lambda out: F.transform("nodes", lambda n: F.when(n == F.col(out), F.col("mid")).otherwise(n))  # noqa: E731  keeps the orientation
        children = both.select("eid", swap("b").alias("nodes")).unionByName(both.select(F.col("child").alias("eid"), swap("a").alias("nodes")))
        elements = save(elements.join(split.select("eid"), "eid", "left_anti").unionByName(children))
        goal, queue = save(goal.join(split, "eid", "left_anti")), save(queue.join(split, "eid", "left_anti"))
    return elements, nodes


def bisect_near(elements: DataFrame, nodes: DataFrame, seeds: DataFrame, radius: float, waves: int, save, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Waves of ``bisect``: each marks the elements whose centroid lies within radius of a seed (sid, x, y, z), at most a share of them."""
    from .spatial import near_any

    for _ in range(waves):
        corner = elements.select("eid", F.explode("nodes").alias("nid")).join(nodes, "nid")
        centroid = save(corner.groupBy("eid").agg(*[F.avg(c).alias(c) for c in "xyz"]).withColumnRenamed("eid", "pid"))
        close = near_any(centroid, seeds, radius).select(F.col("pid").alias("eid"))
        most = max(8, int(share * elements.count()))
        marked = save(close)
        if marked.count() > most:
            from .ordered import ranked

            marked = save(ranked(marked, "eid", [], "_r", descending=False).filter(F.col("_r") <= most).select("eid"))
        elements, nodes = bisect(elements, nodes, marked, save)
    return elements, nodes
