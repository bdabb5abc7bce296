"""Iterative site and node relaxation: sampled Lloyd, bubble packing, Jacobi smoothing, adaptive marking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import nearest, within


def lloyd(sites: DataFrame, samples: DataFrame, size: float, tol: float, save, most: int = 20) -> DataFrame:
    """Sampled centroidal relaxation.  sites: sid, x, y, z, fixed; samples: pid, x, y, z, w (density).

    Each round assigns samples to their nearest site and moves free sites to the
    weighted mean, until no site moves further than tol.
    """
    sites = save(sites)
    for _ in range(most):
        own = nearest(samples.select("pid", "x", "y", "z"), sites.select("sid", "x", "y", "z"), size, save)
        mean = own.join(samples, "pid").groupBy("sid").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m{c}") for c in "xyz"])
        joined = sites.join(mean, "sid", "left")
        to = {c: F.when(F.col("fixed") | F.col(f"m{c}").isNull(), F.col(c)).otherwise(F.col(f"m{c}")) for c in "xyz"}
        step = save(joined.select("sid", *[to[c].alias(c) for c in "xyz"], "fixed", F.sqrt(sum(((to[c] - F.col(c)) * (to[c] - F.col(c)) for c in "yz"), (to["x"] - F.col("x")) * (to["x"] - F.col("x")))).alias("move")))
        sites = step.drop("move")
        if (step.agg(F.max("move")).first()[0] or 0.0) <= tol:
            break
    return sites


def bubble(sites: DataFrame, spacing: float, save, rounds: int = 8, rate: float = 0.5) -> DataFrame:
    """Pushes free sites apart where they are nearer than spacing: sums of pair pushes, one range join a round."""
    sites = save(sites)
    for _ in range(rounds):
        a = sites.select(F.col("sid").alias("pid"), "x", "y", "z")
        pairs = within(a, sites.select("sid", "x", "y", "z"), spacing).filter("pid <> sid AND d2 > 0")
        pairs = pairs.join(a.toDF("pid", "px", "py", "pz"), "pid").join(sites.select("sid", *[F.col(c).alias(f"s{c}") for c in "xyz"]), "sid")
        d = F.sqrt("d2")
        push = pairs.groupBy("pid").agg(*[F.sum((F.col(f"p{c}") - F.col(f"s{c}")) / d * (spacing - d) / 2).alias(f"d{c}") for c in "xyz"])
        sites = save(sites.join(push, sites.sid == push.pid, "left").select("sid", *[F.when(F.col("fixed"), F.col(c)).otherwise(F.col(c) + rate * F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "xyz"], "fixed"))
    return sites


def smooth(nodes: DataFrame, edges: DataFrame, save, rounds: int = 5, rate: float = 0.5) -> DataFrame:
    """Jacobi smoothing: free nodes move towards the mean of their neighbours.  nodes: nid, x, y, z, fixed; edges: a, b."""
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    nodes = save(nodes)
    for _ in range(rounds):
        mean = both.join(nodes.select(F.col("nid").alias("b"), "x", "y", "z"), "b").groupBy("a").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        nodes = save(nodes.join(mean, nodes.nid == mean.a, "left").select("nid", *[F.when(F.col("fixed"), F.col(c)).otherwise(F.col(c) + rate * (F.coalesce(f"m{c}", F.col(c)) - F.col(c))).alias(c) for c in "xyz"], "fixed"))
    return nodes


def wall_smooth(nodes: DataFrame, edges: DataFrame, elements: DataFrame, save, rounds: int = 5, rate: float = 0.5, most_step: float | None = None, project=None) -> tuple[DataFrame, int]:
    """Smoothing that turns no element.  nodes: nid, x, y, z, fixed; edges: a, b; elements: eid, nodes (tetrahedra).

    Each round tries the step of ``smooth`` (no longer than ``most_step``), lets
    ``project(nodes)`` (nid, x, y, z) put the moved nodes back on their surface, and
    then returns all nodes of turned elements to where the round began, until no
    element is turned by it: a node that returns can turn others, so this is a
    fixpoint, reached at the latest when every node has returned.  Elements that were
    turned before don't move.  Returns (nodes, how many steps were returned).
    """
    from ..operators.surface import turned

    nodes, at_fault, returned = save(nodes.select("nid", "x", "y", "z", "fixed")), turned(elements), 0
    for _ in range(rounds):
        tried = smooth(nodes, edges, save, 1, rate)
        old = nodes.select("nid", *[F.col(c).alias(f"o{c}") for c in "xyz"])
        step = tried.join(old, "nid")
        if most_step is not None:
            d = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "yz"), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox"))))
            share = F.least(F.lit(1.0), most_step / F.nullif(d, F.lit(0.0)))
            step = step.select("nid", *[(F.col(f"o{c}") + (F.col(c) - F.col(f"o{c}")) * F.coalesce(share, F.lit(1.0))).alias(c) for c in "xyz"], "fixed", "ox", "oy", "oz")
        if project is not None:
            onto = save(project(step.filter("NOT fixed AND (x <> ox OR y <> oy OR z <> oz)").select("nid", "x", "y", "z")))
            step = step.join(onto.toDF("nid", "px", "py", "pz"), "nid", "left").select("nid", *[F.coalesce(f"p{c}", c).alias(c) for c in "xyz"], "fixed", "ox", "oy", "oz")
        state = save(step)
        while True:
            moved = state.filter("x <> ox OR y <> oy OR z <> oz").select("nid")
            undo = save(at_fault(state).select("nid").distinct().join(moved, "nid"))
            n = undo.count()
            if not n:
                break
            returned += n
            state = save(state.join(undo.withColumn("undo", F.lit(True)), "nid", "left").select("nid", *[F.when(F.col("undo"), F.col(f"o{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"], "fixed", "ox", "oy", "oz"))
        nodes = save(state.select("nid", "x", "y", "z", "fixed"))
    return nodes, returned


def refine_suggestion(elements: DataFrame, theta: float, h: float, factor: float, h_min: float = 0.0) -> tuple[DataFrame, float, float]:
    """(marked elements, next size, width of the seed band).  elements: eid, eta.  Below a twentieth of marked elements the size stays."""
    from ..operators.ordered import dorfler_mark

    marked = dorfler_mark(elements, "eta", theta, ["eid"])
    n, k = marked.agg(F.count("*"), F.count_if("marked")).first()
    stays = k == 0 or k / n < 0.05
    return marked.filter("marked").drop("marked"), h if stays else max(h * factor, h_min), 1.5 * h


def adapt(step, h: float, theta: float, target: float, factor: float = 0.75, h_min: float = 0.0, most: int = 8) -> list[tuple[int, float, float]]:
    """Mesh, solve, estimate, mark, refine: ``step(h)`` returns the elements' eta (eid, eta).

    Ends at the target for the root of summed squares, or where the size no longer
    changes.  Returns (pass, size, error) of each pass.
    """
    out = []
    for k in range(most):
        elements = step(h)
        error = float(elements.agg(F.sqrt(F.sum(F.col("eta") * F.col("eta")))).first()[0] or 0.0)
        out.append((k, h, error))
        _, after, _ = refine_suggestion(elements, theta, h, factor, h_min)
        if error <= target or after == h:
            break
        h = after
    return out
