"""Clipped Voronoi cells of sites in a box.

A cell is cut from the box by the half-spaces of other sites.  Which sites matter is
found in two parts:

* Sites go block by block (8 x 8 x 8 grid cells of half a ``size``) to tasks that
  have the sites of the block and of two grid cells around it; of a crowded grid cell
  only one represents it, and a crowded block's own sites are dealt out, so a task is
  bounded whatever the density.  All cells of a share are cut at once, each by its 128
  nearest sites.  Where none around was crowded and the furthest corner is nearer than
  half of ``size`` and of the last of those sites, no other can reach it: it is final.
* The others ask for the nearest site of each corner of their cell.  A corner that is
  nearer to a foreign site is cut off by that one in the next round; a cell all of
  whose corners are its own is final, since a site that cuts a convex cell cuts off
  one of its corners.  There is no round limit: each round adds a site to every cell
  that stays open.

Sites in one place: the least id has the cell, the others an empty one.  Sites may
lie outside the box.  Null coordinates give no cell and cut none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import vec
from ..functions.voronoi import box_faces, cells_at_once, cut, faces_at_once, mass_and_centroid, reach, restricted_cell
from .spatial import cell, nearest

CROWD = 16
_SITE = "array<struct<id:long,x:double,y:double,z:double>>"
_CELL = f"sid long, x double, y double, z double, volume double, mass double, cx double, cy double, cz double, corners array<array<double>>, faces array<struct<owner:long,points:array<array<double>>>>, safe boolean, near {_SITE}"
_NAMES = ["sid", "x", "y", "z", "volume", "mass", "cx", "cy", "cz", "corners", "faces", "safe", "near"]
#: Grid cells along a block, sites of a crowded block that one task has at once, and others that a cell is cut by at first.
BLOCK, CHUNK, NEAR = 8, 4096, 128


def _table(lo, hi, planes, size_at, eps: float, sid: np.ndarray, at: np.ndarray, names: np.ndarray, gap: np.ndarray, step: np.ndarray, covered: np.ndarray) -> list[pa.RecordBatch]:
    """The cells of sites ``at`` under the others (names and steps (n, K), nearest first); what is not ``covered`` gets its corners and others too.

    covered holds the distance up to which all others are among them.
    """
    flat = lambda x: pa.array(np.ascontiguousarray(x).reshape(-1))
    spans = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    points = lambda p: pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(p) + 1, 3, dtype=np.int32)), flat(p))
    n, out = len(sid), []
    if planes:  # corners of more than three planes
        sure = np.zeros(n, bool)
    else:
        cell, tri, pos, far, sure = cells_at_once(lo, hi, at, gap, step, eps)
        fine = sure[cell]
        owner, plane, count, p, volume, mass, centre = faces_at_once(n, cell[fine], tri[fine], pos[fine], step, size_at)
        owners = np.where(plane < 6, -1 - plane, names[owner, np.maximum(plane - 6, 0)] if names.shape[1] else 0)
        faces = pa.ListArray.from_arrays(spans(np.bincount(owner, minlength=n)), pa.StructArray.from_arrays([pa.array(owners.astype(np.int64)), pa.ListArray.from_arrays(spans(count), points(p))], ["owner", "points"]))
        safe = (2 * far <= covered) | (np.bincount(cell, minlength=n) == 0)
        more = ~safe[cell[fine]]
        corners = pa.ListArray.from_arrays(spans(np.bincount(cell[fine][more], minlength=n)), points(pos[fine][more][np.argsort(cell[fine][more], kind="stable")]))
        columns = [volume, mass, *np.where(mass > 0, centre.T, np.nan)]
        out.append([pa.array(sid), *[pa.array(c, mask=np.isnan(c)) for c in columns], corners, faces, pa.array(safe)])
    box, slow = box_faces(lo, hi), []
    for normal, level in planes:
        length = float(np.linalg.norm(normal))
        box = cut(box, np.asarray(normal, float) / length, level / length, -7, eps)
    for i in np.flatnonzero(~sure):
        own = np.isfinite(gap[i])
        found = restricted_cell(box, at[i], sid[i], at[i] + step[i][own], names[i][own], eps)
        v, m, c = mass_and_centroid(found, size_at)
        safe = not found or 2 * reach(found, at[i]) <= covered[i]
        corner = [] if safe else np.unique(np.concatenate([p for _, p in found]).round(15), axis=0).tolist()
        slow.append((sid[i], v, m, *(c.tolist() if m > 0 else [None] * 3), corner, [{"owner": o, "points": p.tolist()} for o, p in found], safe))
    kinds = (pa.int64(), *[pa.float64()] * 5, pa.list_(pa.list_(pa.float64())), pa.list_(pa.struct([("owner", pa.int64()), ("points", pa.list_(pa.list_(pa.float64())))])), pa.bool_())
    where = [np.flatnonzero(sure), np.flatnonzero(~sure)] if not planes else [np.flatnonzero(~sure)]
    if slow or not out:
        out.append([pa.array(c, t) for c, t in zip(zip(*slow, strict=True) if slow else [[]] * 9, kinds, strict=True)])
    batches = []
    for rows, cols in zip(where, out, strict=False):
        if len(cols[0]) == n and len(rows) < n:
            cols = [c.take(pa.array(rows)) for c in cols]
        open_ = ~cols[-1].to_numpy(zero_copy_only=False)
        near = [[{"id": int(names[i, k]), **dict(zip("xyz", (at[i] + step[i, k]).tolist(), strict=True))} for k in np.flatnonzero(np.isfinite(gap[i]))] if o else [] for i, o in zip(rows, open_, strict=True)]
        place = [pa.array(at[rows, c]) for c in range(3)]
        batches.append(pa.RecordBatch.from_arrays([cols[0], *place, *[c.cast(t) for c, t in zip(cols[1:], kinds[1:], strict=True)], pa.array(near, pa.list_(pa.struct([("id", pa.int64()), *[(c, pa.float64()) for c in "xyz"]])))], _NAMES))
    return batches


def _starts(lo, hi, size: float, planes, size_at, eps: float):
    """cells(own, around): the cells of a block's own sites under those around, as Arrow tables."""
    half = size / 2
    side = BLOCK + 4
    empty = lambda n: (np.zeros((n, 0), np.int64), np.zeros((n, 0)), np.zeros((n, 0, 3)))

    def run(own: pa.Table, around: pa.Table) -> pa.Table:
        number = lambda t, *names: np.stack([t[x].to_numpy() for x in names], axis=1)
        sid, at = own["sid"].to_numpy(), number(own, "x", "y", "z").astype(float)
        if not len(sid):
            return pa.table({f.name: pa.array([], f.type) for f in _table(lo, hi, planes, size_at, eps, sid, at, *empty(0), np.zeros(0))[0].schema})
        ids, spots, crowded = around["sid"].to_numpy(), number(around, "x", "y", "z").astype(float), around["crowded"].to_numpy()
        grid = lambda p: np.floor(p / half).astype(np.int64)
        base = grid(at) // BLOCK * BLOCK - 2
        code = lambda g: (g[:, 0] * side + g[:, 1]) * side + g[:, 2]
        codes = code(grid(spots) - base[0])
        order = np.argsort(codes, kind="stable")
        ids, spots, crowded, codes = ids[order], spots[order], crowded[order], codes[order]
        mine = code(grid(at) - base)
        by = np.argsort(mine, kind="stable")
        runs = np.array([(i * side + j) * side for i in range(-2, 3) for j in range(-2, 3)])
        batches, waiting = [], []

        def settle(part):
            who, *near = (np.concatenate(x) for x in zip(*part, strict=True))
            batches.extend(_table(lo, hi, planes, size_at, eps, sid[who], at[who], *near))

        def others(who, near, most):
            d = spots[near][None] - at[who][:, None]
            gap = np.sqrt((d * d).sum(axis=2))
            gap[ids[near][None] == sid[who][:, None]] = np.inf
            first = np.argsort(gap, axis=1, kind="stable")[:, :most]
            gap = np.take_along_axis(gap, first, 1)
            wide = np.full((len(who), most), np.inf)
            wide[:, : gap.shape[1]] = gap
            names, step = np.full((len(who), most), -9, np.int64), np.zeros((len(who), most, 3))
            names[:, : gap.shape[1]] = ids[near][first]
            step[:, : gap.shape[1]] = np.where(np.isfinite(gap)[:, :, None], np.take_along_axis(d, first[:, :, None], 1), 0)
            return names, wide, step

        for here in np.split(by, np.flatnonzero(np.diff(mine[by])) + 1):
            low, high = (np.searchsorted(codes, mine[here[0]] + runs + v, how) for v, how in ((-2, "left"), (2, "right")))
            near = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            sound = 0.0 if crowded[near].any() else size
            for some in np.array_split(here, -(-len(here) // 256)):
                names, gap, step = others(some, near, NEAR)
                covered = np.full(len(some), sound) if len(near) <= NEAR + 1 else np.minimum(sound, gap[:, -1])
                waiting.append((some, names, gap, step, covered))
            if sum(len(x[0]) for x in waiting) >= 1024:
                settle(waiting)
                waiting = []
        if waiting:
            settle(waiting)
        return pa.Table.from_batches(batches)

    return run


def _again(rows: DataFrame, lo, hi, planes, size_at, eps: float) -> DataFrame:
    """The cells of (sid, x, y, z, near) under the sites named in near; none is safe unless it is empty."""

    def run(batches):
        for batch in batches:
            rows_ = batch.to_pylist()
            for start in range(0, len(rows_), 256):
                some = rows_[start : start + 256]
                most = max(len(x["near"]) for x in some)
                at = np.array([[x["x"], x["y"], x["z"]] for x in some], float)
                names, gap, step = np.full((len(some), most), -9, np.int64), np.full((len(some), most), np.inf), np.zeros((len(some), most, 3))
                for i, x in enumerate(some):
                    d = np.array([(s["x"], s["y"], s["z"]) for s in x["near"]], float).reshape(-1, 3) - at[i]
                    g = np.sqrt((d * d).sum(axis=1))
                    order = np.argsort(g, kind="stable")
                    names[i, : len(g)], gap[i, : len(g)], step[i, : len(g)] = np.array([s["id"] for s in x["near"]], np.int64)[order], g[order], d[order]
                yield from _table(lo, hi, planes, size_at, eps, np.array([x["sid"] for x in some], np.int64), at, names, gap, step, np.zeros(len(some)))

    return rows.select("sid", "x", "y", "z", "near").mapInArrow(run, _CELL)


def voronoi_cells(sites: DataFrame, lo, hi, size: float, save, planes=(), size_at: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(sid, volume, mass, cx, cy, cz, faces): the cell of each site (sid, x, y, z) in the box lo to hi.

    A face has its owner (the site beyond it, -1 to -6 for the box's sides, -7 for
    ``planes``) and its corners.  ``planes`` are (normal, level) of half-spaces
    normal . x <= level that bound a convex domain.  ``size_at`` gives the size wanted
    at points (n, 3), the density being one over its cube.  ``size`` is some two to
    three times the usual distance between sites; a bad one costs rounds only.
    """
    eps = 1e-12 * max(abs(float(v)) for v in (*lo, *hi, *np.subtract(hi, lo)))
    every = save(sites.select("sid", "x", "y", "z").filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"))
    s = save(every.groupBy("x", "y", "z").agg(F.min("sid").alias("sid")).select("sid", "x", "y", "z"))
    placed = s.withColumn("cell", cell(vec(""), size / 2))
    full = save(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("sid", "x", "y", "z")).alias("one")))
    sparse = placed.hint("merge").join(full.filter(F.col("n") > CROWD).select("cell"), "cell", "left_anti").select("cell", "sid", "x", "y", "z", F.lit(False).alias("crowded"))
    crowded = full.filter(F.col("n") > CROWD).select("cell", "one.*", F.lit(True).alias("crowded"))
    block = F.struct(*[F.floor(F.col(f"cell.{n}") / BLOCK).alias(n) for n in "ijk"])
    chunks = full.groupBy(block.alias("block")).agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    own = placed.withColumn("block", block).hint("merge").join(chunks, "block").select("block", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int").alias("chunk"), "sid", "x", "y", "z")
    ways = F.struct(*[F.sequence(F.floor((F.col(f"cell.{n}") - 2) / BLOCK), F.floor((F.col(f"cell.{n}") + 2) / BLOCK)).alias(n) for n in "ijk"])
    around = sparse.unionByName(crowded).withColumn("ways", ways)
    for n in "ijk":
        around = around.withColumn(n, F.explode(f"ways.{n}"))
    around = around.withColumn("block", F.struct("i", "j", "k")).select("block", "sid", "x", "y", "z", "crowded").hint("merge").join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    run = _starts(lo, hi, size, planes, size_at, eps)
    made = save(own.groupBy("block", "chunk").cogroup(around.select(*[F.col(n).alias(n) for n in ("block", "chunk", "sid", "x", "y", "z", "crowded")]).groupBy("block", "chunk")).applyInArrow(run, _CELL))
    result = ["sid", "volume", "mass", "cx", "cy", "cz", "faces"]
    done = made.filter("safe").select(*result)
    made = made.filter("NOT safe")
    while True:
        probes = save(made.select("sid", "x", "y", "z", F.explode("corners").alias("c")).select(F.struct("sid", F.col("c")).alias("pid"), "x", "y", "z", *[F.col("c")[n].alias(f"c{x}") for n, x in enumerate("xyz")]).distinct())
        found = nearest(probes.select("pid", *[F.col(f"c{x}").alias(x) for x in "xyz"]), s, size, save)
        gap = sum(((F.col(f"c{x}") - F.col(x)) * (F.col(f"c{x}") - F.col(x)) for x in "yz"), (F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")))
        nearer = probes.hint("merge").join(found.withColumnRenamed("sid", "id"), "pid").filter((F.col("id") != F.col("pid.sid")) & (F.col("d2") < gap * (1 - 1e-9))).select(F.col("pid.sid").alias("sid"), "id").distinct()
        nearer = nearer.hint("merge").join(made.select("sid", F.col("near.id").alias("known")), "sid").filter(~F.array_contains("known", F.col("id")))  # within rounding
        added = save(nearer.hint("merge").join(s.select(F.col("sid").alias("id"), "x", "y", "z"), "id").groupBy("sid").agg(F.collect_list(F.struct("id", "x", "y", "z")).cast(_SITE).alias("added")))
        done = done.unionByName(made.hint("merge").join(added.select("sid"), "sid", "left_anti").select(*result))
        if added.isEmpty():
            shadowed = every.hint("merge").join(s, "sid", "left_anti").select("sid", *[F.lit(v).cast("double").alias(c) for c, v in (("volume", 0), ("mass", 0), ("cx", None), ("cy", None), ("cz", None))], F.array().cast(done.schema["faces"].dataType).alias("faces"))
            return done.unionByName(shadowed)
        grown = save(made.select("sid", "x", "y", "z", "near").hint("merge").join(added, "sid").select("sid", "x", "y", "z", F.array_distinct(F.concat("near", "added")).alias("near")))
        made = save(_again(grown, lo, hi, planes, size_at, eps))


def lloyd_cells(sites: DataFrame, lo, hi, size: float, tol: float, save, size_at: Callable[[np.ndarray], np.ndarray] | None = None, planes=(), most: int = 20) -> DataFrame:
    """Centroidal relaxation by whole cells.  sites: sid, x, y, z, fixed.

    Free sites move to the weighted centroid of their cell until none moves further
    than tol, or ``most`` rounds are over; ``move`` is what the last round moved, so a
    result that hasn't settled shows it.  Sites with an empty cell stay.
    """
    now = save(sites.select("sid", "x", "y", "z", "fixed"))
    for _ in range(most):
        centres = voronoi_cells(now, lo, hi, size, save, planes, size_at).select("sid", "cx", "cy", "cz")
        to = {c: F.when(F.col("fixed") | F.col(f"c{c}").isNull(), F.col(c)).otherwise(F.col(f"c{c}")) for c in "xyz"}
        move = F.sqrt(sum(((to[c] - F.col(c)) * (to[c] - F.col(c)) for c in "yz"), (to["x"] - F.col("x")) * (to["x"] - F.col("x"))))
        now = save(now.join(centres, "sid", "left").select("sid", *[to[c].alias(c) for c in "xyz"], "fixed", move.alias("move")))
        if (now.agg(F.max("move")).first()[0] or 0.0) <= tol:
            break
    return now
