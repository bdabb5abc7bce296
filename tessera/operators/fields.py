"""Field analytics: nodal averages, patch recovery, sparse products, health, scorecards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stress components in the order of the six-vector.
VOIGT = ("sxx", "syy", "szz", "syz", "sxz", "sxy")


def nodal_average(incidence: DataFrame, values: DataFrame, columns: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """Mean of element values at each node; 0 at nodes of no element (if nodes are given).

    incidence: eid, nid; values: eid, columns.
    """
    out = incidence.join(values.select("eid", *columns), "eid").groupBy("nid").agg(*[F.avg(c).alias(c) for c in columns])
    if nodes is None:
        return out
    return nodes.select("nid").join(out, "nid", "left").select("nid", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def _moments(xs: list[str], y: str) -> list[Column]:
    names = ["one", *xs]
    terms = [F.lit(1.0), *[F.col(c) for c in xs]]
    out = [F.sum(terms[i] * terms[j]).alias(f"m_{names[i]}_{names[j]}") for i in range(len(terms)) for j in range(i, len(terms))]
    return out + [F.sum(terms[i] * F.col(y)).alias(f"r_{names[i]}") for i in range(len(terms))]


def patch_line(df: DataFrame, by: list[str], x: str, y: str, at: float, least: int) -> DataFrame:
    """Per group the least-squares line a + b x at ``at``, or the mean below ``least`` rows or where x doesn't vary."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    fitted = F.col("a") + F.col("b") * at
    return g.select(*by, "n", F.when((F.col("n") >= least) & fitted.isNotNull(), fitted).otherwise(F.col("mean")).alias("value"))


def recover_patches(incidence: DataFrame, stresses: DataFrame, nodes: DataFrame, least: int = 4) -> DataFrame:
    """Recovered nodal stresses: per node a linear fit over its elements' centroids, the mean below ``least`` elements.

    The normal equations are sums (partial aggregates); only the small solves, one
    4 x 4 system a node, run in numpy batches.  Coordinates are relative to the node.
    """
    flat = incidence.join(stresses, "eid").join(nodes.select("nid", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz")), "nid")
    flat = flat.withColumns({"dx": F.col("cx") - F.col("nx"), "dy": F.col("cy") - F.col("ny"), "dz": F.col("cz") - F.col("nz")})
    terms = [F.lit(1.0), F.col("dx"), F.col("dy"), F.col("dz")]
    sums = [F.sum(terms[i] * terms[j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)]
    sums += [F.sum(terms[i] * F.col(s)).alias(f"{s}{i}") for s in VOIGT for i in range(4)]
    grouped = flat.groupBy("nid").agg(*sums)

    def solve(batches):
        for b in batches:
            m = np.zeros((len(b), 4, 4))
            for i in range(4):
                for j in range(i, 4):
                    m[:, i, j] = m[:, j, i] = b[f"m{i}{j}"]
            r = np.stack([b[[f"{s}{i}" for i in range(4)]].to_numpy() for s in VOIGT], axis=2)
            n = m[:, 0, 0]
            out = r[:, 0, :] / n[:, None]
            scale = np.maximum(np.abs(m).max(axis=(1, 2)), 1e-300)
            good = (n >= least) & (np.abs(np.linalg.det(m / scale[:, None, None])) > 1e-12)
            if good.any():
                out[good] = np.linalg.solve(m[good], r[good])[:, 0, :]  # the value at the node itself
            yield pd.DataFrame({"nid": b["nid"], **{s: out[:, k] for k, s in enumerate(VOIGT)}})

    return grouped.mapInPandas(solve, "nid long, " + ", ".join(f"{s} double" for s in VOIGT))


def recovery_error(incidence: DataFrame, stresses: DataFrame, nodal: DataFrame) -> DataFrame:
    """(eid, eta): size of the difference between an element's stress and the mean of its nodes'."""
    mean = incidence.join(nodal, "nid").groupBy("eid").agg(*[F.avg(s).alias(f"n_{s}") for s in VOIGT])
    own = stresses.join(mean, "eid")
    total = None
    for s in VOIGT:
        d = F.col(s) - F.col(f"n_{s}")
        total = d * d if total is None else total + d * d
    return own.select("eid", F.sqrt(total).alias("eta"))


def assemble(triplets: DataFrame) -> DataFrame:
    """Sums duplicate entries of (row, col, val)."""
    return triplets.groupBy("row", "col").agg(F.sum("val").alias("val"))


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, val) of the product of COO entries with a vector (i, val)."""
    return matrix.join(x.select(F.col("i").alias("col"), F.col("val").alias("xv")), "col").groupBy(F.col("row").alias("i")).agg(F.sum(F.col("val") * F.col("xv")).alias("val"))


def dot(a: DataFrame, b: DataFrame) -> float:
    """Inner product of two vectors (i, val); one number."""
    return float(a.join(b.select("i", F.col("val").alias("w")), "i").agg(F.sum(F.col("val") * F.col("w")).alias("d")).first()["d"] or 0.0)


def strain_energy(matrix: DataFrame, u: DataFrame) -> float:
    return 0.5 * dot(spmv(matrix, u), u)


def eliminate(matrix: DataFrame, load: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The free block and its load: K_ff and f_f - K_fc u_c.  fixed: dof, value."""
    known = fixed.select(F.col("dof").alias("i"), F.col("value").alias("val"))
    free_rows = matrix.join(known.select(F.col("i").alias("row")), "row", "left_anti")
    moved = spmv(free_rows.join(known.select(F.col("i").alias("col")), "col", "left_semi"), known).select("i", (-F.col("val")).alias("val"))
    f = load.join(known.select("i"), "i", "left_anti").unionByName(moved).groupBy("i").agg(F.sum("val").alias("val"))
    return free_rows.join(known.select(F.col("i").alias("col")), "col", "left_anti"), f


def conjugate_gradient(matrix: DataFrame, b: DataFrame, save, tol: float = 1e-9, most: int = 500, on_progress=None) -> DataFrame:
    """Solves for x (i, val) with the diagonal as preconditioner; vectors stay distributed, scalars reach the driver.

    An error is raised where ``most`` rounds do not reach the tolerance.
    """
    matrix = save(matrix)
    diagonal = save(matrix.filter("row = col").select(F.col("row").alias("i"), F.col("val").alias("d")))
    ids = matrix.select(F.col("row").alias("i")).distinct()
    state = ids.join(b, "i", "left").join(diagonal, "i", "left").select("i", F.lit(0.0).alias("x"), F.coalesce("val", F.lit(0.0)).alias("r"), F.coalesce(F.nullif(F.col("d"), F.lit(0.0)), F.lit(1.0)).alias("d"))
    state = save(state.withColumn("p", F.col("r") / F.col("d")))
    first = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
    rz, start = first["rz"] or 0.0, first["rr"] or 0.0
    for step in range(most):
        if not start or rz == 0:
            break
        q = spmv(matrix, state.select("i", F.col("p").alias("val"))).select("i", F.col("val").alias("q"))
        state = save(state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))))
        alpha = rz / state.agg(F.sum(F.col("p") * F.col("q")).alias("a")).first()["a"]
        state = state.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("q")).drop("q")
        now = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz"), F.sum(F.col("r") * F.col("r")).alias("rr")).first()
        if on_progress:
            on_progress(step + 1, (now["rr"] / start) ** 0.5)
        if now["rr"] <= tol * tol * start:
            break
        state = save(state.withColumn("p", F.col("r") / F.col("d") + (now["rz"] / rz) * F.col("p")))
        rz = now["rz"]
    else:
        if start and rz:
            raise ArithmeticError(f"conjugate gradients did not reach {tol} in {most} rounds")
    return state.select("i", F.col("x").alias("val"))


def solve_health(residual: DataFrame, load: DataFrame, fixed: DataFrame) -> DataFrame:
    """One row: residual of free dofs against the load's size, and how far reactions are from balancing loads by axis."""
    r = residual.join(fixed.select(F.col("dof").alias("i"), F.lit(True).alias("held")), "i", "left")
    axis = F.pmod("i", F.lit(3))
    own = r.agg(F.sqrt(F.sum(F.when(F.col("held").isNull(), F.col("val") * F.col("val")))).alias("free"), *[F.sum(F.when(F.col("held") & (axis == a), F.col("val"))).alias(f"reaction_{a}") for a in range(3)])
    total = load.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("size"), *[F.sum(F.when(axis == a, F.col("val"))).alias(f"load_{a}") for a in range(3)])
    both = own.crossJoin(total)  # two single rows
    worst = F.greatest(*[F.abs(F.coalesce(f"reaction_{a}", F.lit(0.0)) + F.coalesce(f"load_{a}", F.lit(0.0))) for a in range(3)])
    return both.select((F.col("free") / F.nullif(F.col("size"), F.lit(0.0))).alias("free_residual_rel"), (worst / F.nullif(F.col("size"), F.lit(0.0))).alias("reaction_sum_err"))


def tet_quality(values: DataFrame) -> DataFrame:
    """One row over volume and aspect: extremes, mean, slivers (aspect below 0.05); zeros for no element."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return values.agg(F.count("*").alias("n"), z(F.min("volume")).alias("min_volume"), z(F.max("volume")).alias("max_volume"), z(F.min("aspect")).alias("min_aspect"), F.round(z(F.avg("aspect")), 6).alias("mean_aspect"), F.count_if(F.col("aspect") < 0.05).alias("n_slivers"))


def entity_minimum(incidence: DataFrame, order: DataFrame) -> DataFrame:
    """An entity's order: the least of its elements'.  incidence: eid, entity; order: eid, p."""
    return incidence.join(order, "eid").groupBy("entity").agg(F.min("p").alias("p"))


def majority(votes: DataFrame, by: list[str], vote: str, keep: str = "keep") -> DataFrame:
    """The one vote with most voices, or ``keep`` on a tie."""
    counts = votes.groupBy(*by, vote).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max("n").alias("most"), F.max_by(vote, "n").alias("winner"), F.sum("n").alias("voices"))
    ties = counts.join(top.select(*by, "most"), by).filter("n = most").groupBy(*by).agg(F.count("*").alias("tied"))
    return top.join(ties, by).select(*by, "voices", F.when(F.col("tied") == 1, F.col("winner")).otherwise(F.lit(keep)).alias("winner"))


def vertex_curvature(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, kappa): turning of the edges between exactly two triangles, over four times the one-ring area.

    triangles: tid, nodes, area, nx, ny, nz; vertices: vid, x, y, z.
    """
    from .topology import edges

    area = triangles.select(F.explode("nodes").alias("vid"), "area").groupBy("vid").agg((F.sum("area") / 3).alias("area"))
    e = edges(triangles, ["tid", "nx", "ny", "nz"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("tid", "nx", "ny", "nz")).alias("p"), F.max(F.struct("tid", "nx", "ny", "nz")).alias("q")).filter("n = 2")
    dot_n = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p.nx") * F.col("q.nx") + F.col("p.ny") * F.col("q.ny") + F.col("p.nz") * F.col("q.nz")))
    ends = e.withColumn("theta", F.acos(dot_n))
    for n in "ab":
        ends = ends.join(vertices.select(F.col("vid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), n)
    length = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "yz"), (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx"))))
    turn = ends.select(F.explode(F.array("a", "b")).alias("vid"), (F.col("theta") * length).alias("t")).groupBy("vid").agg(F.sum("t").alias("turn"))
    return area.join(turn, "vid", "left").select("vid", (F.coalesce("turn", F.lit(0.0)) / (4 * F.nullif(F.col("area"), F.lit(0.0)))).alias("kappa"))


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): area-weighted unit normals; +z where they cancel."""
    sums = triangles.select(F.explode("nodes").alias("vid"), *[(F.col(f"n{c}") * F.col("area")).alias(f"n{c}") for c in "xyz"]).groupBy("vid").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"])
    size = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return sums.select("vid", *[F.coalesce(F.col(f"s{c}") / F.nullif(size, F.lit(0.0)), F.lit(d)).alias(f"n{c}") for c, d in zip("xyz", (0.0, 0.0, 1.0), strict=True)])


def distance_summary(distances: DataFrame, d2: str = "d2", within: float = 1e-6) -> DataFrame:
    """One row: largest and mean distance (the largest is the one-sided Hausdorff distance) and how many lie on the surface."""
    d = F.sqrt(d2)
    return distances.agg(F.max(d).alias("max"), F.avg(d).alias("mean"), F.count("*").alias("n"), F.count_if(d <= within).alias("n_on"))


def chordal_efficiency(segments: DataFrame) -> DataFrame:
    """One row: the largest d / (length^2 kappa / 8): 1 for a chord of a circle.  segments: d, length, kappa."""
    ideal = F.col("length") * F.col("length") * F.col("kappa") / 8
    return segments.filter("kappa > 0 AND length > 0").agg(F.max(F.col("d") / ideal).alias("efficiency_max"))


def weighted_scorecard(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score: the weighted mean of the metrics that are present (weights renormalised)."""
    num = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return metrics.withColumn("score", num / F.nullif(den, F.lit(0.0)))


def displacement_summary(displacement: DataFrame, face: DataFrame, axis: str) -> DataFrame:
    """One row: mean size and mean component over the face's nodes, largest size over all nodes."""
    size = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    on = displacement.join(face.select("nid").distinct().withColumn("on", F.lit(True)), "nid", "left")
    return on.agg(F.avg(F.when(F.col("on"), size)).alias("face_mean"), F.avg(F.when(F.col("on"), F.col(axis))).alias("face_component"), F.max(size).alias("global_max"))


def short_features(edges: DataFrame, h: float) -> tuple[DataFrame, DataFrame]:
    """(one row: sharp edges shorter than 2 h and those flagged; the flagged edges, a third of whose length is below a quarter of h)."""
    third, least = F.col("length") / 3, F.lit(h / 4)
    sharp = edges.filter("feature = 'sharp'")
    flags = sharp.filter(third < least).select("id", F.lit("below_h_min").alias("reason"), "length", third.alias("h_edge"), least.alias("h_min"))
    return sharp.agg(F.count_if(F.col("length") < 2 * h).alias("n_short"), F.count_if(third < least).alias("n_flagged")), flags


def slab_conditions(nodes: DataFrame, h: float, total: float) -> tuple[DataFrame, DataFrame]:
    """Default conditions: nodes of the least x are held, those of the greatest share a load in x."""
    ends = nodes.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    tol = 0.51 * h
    three = F.array(*[F.col("nid") * 3 + a for a in range(3)])
    held = nodes.filter(F.col("x") <= ends["lo"] + tol).select(F.explode(three).alias("dof"), F.lit(0.0).alias("value"))
    loaded = nodes.filter(F.col("x") >= ends["hi"] - tol)
    n = max(1, loaded.count())  # one number
    return held, loaded.select((F.col("nid") * 3).alias("i"), F.lit(total / n).alias("val"))


def element_to_nodes(incidence: DataFrame, eta: DataFrame, stress: DataFrame, displacement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((nid, eta, von_mises, u): the mean error of a node's elements and the sizes of its stress and displacement; one row of their maxima)."""
    from ..functions.geometry import von_mises

    mean = incidence.join(eta, "eid").groupBy("nid").agg(F.avg("eta").alias("eta"))
    size = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    own = displacement.select("nid", size.alias("u")).join(stress.select("nid", von_mises(*[F.col(c) for c in VOIGT]).alias("von_mises")), "nid", "left").join(mean, "nid", "left")
    own = own.select("nid", F.coalesce("eta", F.lit(0.0)).alias("eta"), F.coalesce("von_mises", F.lit(0.0)).alias("von_mises"), "u")
    return own, own.agg(F.max("eta").alias("max_eta"), F.max("von_mises").alias("max_von_mises"), F.max("u").alias("max_u"))


def mean_edge_length(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row: the mean length over all triangle sides (an inner edge counts from both sides); 1 without any."""
    from .topology import edges

    e = edges(triangles, ["tid"])
    for n in "ab":
        e = e.join(vertices.select(F.col("vid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), n)
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    return e.agg(F.coalesce(F.avg(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])), F.lit(1.0)).alias("mean_edge"))


def solve_method(n_free: int, method: str = "auto", threshold: int = 8000) -> str:
    """direct or cg: as asked, else direct up to ``threshold`` unknowns (a caller with polyhedra raises it)."""
    return method if method != "auto" else "cg" if n_free > threshold else "direct"


#: Unknowns of a dense direct solve (a matrix of 200 MB); beyond them it is refused.
MOST_DENSE = 5000


def direct_solve(matrix: DataFrame, b: DataFrame) -> DataFrame:
    """x (i, val) by a dense Cholesky factor on the driver; at most MOST_DENSE unknowns.  Fails on a singular system."""
    ids = [r["i"] for r in matrix.select(F.col("row").alias("i")).distinct().orderBy("i").limit(MOST_DENSE + 1).collect()]
    if len(ids) > MOST_DENSE:
        raise ValueError(f"more than {MOST_DENSE} unknowns: use conjugate gradients")
    at = {i: k for k, i in enumerate(ids)}
    k, f = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for r in matrix.toLocalIterator():
        k[at[r["row"]], at[r["col"]]] += r["val"]
    for r in b.toLocalIterator():
        if r["i"] in at:
            f[at[r["i"]]] += r["val"]
    try:
        low = np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        raise ArithmeticError("the system is singular: are there enough constraints?") from None
    x = np.linalg.solve(low.T, np.linalg.solve(low, f))
    return matrix.sparkSession.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "i long, val double")


def solve(matrix: DataFrame, b: DataFrame, save, method: str = "auto", threshold: int = 2000, **options) -> DataFrame:
    """Direct or by conjugate gradients, by ``solve_method``."""
    n = matrix.select("row").distinct().count()
    return direct_solve(matrix, b) if solve_method(n, method, threshold) == "direct" else conjugate_gradient(matrix, b, save, **options)
