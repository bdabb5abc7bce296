"""Per-element refinement decisions (size, order or shape), as column expressions.

A decision weighs three gains over their costs.  Geometry that the size does not
resolve (severity from 1 on) rules out raising the order.  Size wins ties, then
order, then shape.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: by how much one shape must fit better than the next to win.
VOTE_MARGIN = 0.08


@dataclass(frozen=True)
class Policy:
    """Thresholds and relative costs."""

    turn_degrees: float = 15.0
    thin_share: float = 0.35
    noise_floor: float = 1e-4
    smooth_ratio: float = 0.45
    gate: float = 1.0
    least_utility: float = 1e-12
    refine: float = 0.75
    h_min: float = 0.0
    cost_h: float = 8.0
    cost_p: float = 2.5
    cost_p_order: float = 0.4
    cost_shape: float = 3.5


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def broadcast_signal(values: Column, index: Column, default: float) -> Column:
    """An empty array gives the default, one value counts for all, else the row's own."""
    return F.when(F.size(values) == 0, F.lit(default)).when(F.size(values) == 1, F.element_at(values, 1)).otherwise(F.element_at(values, index + 1))


def geometry_severity(h: Column, kappa: Column, thickness: Column, policy: Policy = Policy()) -> Column:
    """The worse of turning per element against its threshold and of size against a share of the wall; nulls don't count."""
    turn = F.when((h > 0) & (kappa > 0), h * kappa / (policy.turn_degrees * pi / 180))
    wall = F.when((h > 0) & (thickness > 0), h / F.nullif(policy.thin_share * thickness, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.coalesce(turn, F.lit(0.0)), F.coalesce(wall, F.lit(0.0)))


def shape_vote(hex_fit: Column, tet_fit: Column, poly_fit: Column) -> Column:
    """The best-fitting shape if it leads by the margin, else keep."""
    fits = F.array_sort(F.array(hex_fit, tet_fit, poly_fit))
    best = F.element_at(fits, 3)
    return F.when(best - F.element_at(fits, 2) < VOTE_MARGIN, "keep").when(best == hex_fit, "hex").when(best == tet_fit, "tet").otherwise("poly")


def awkwardness(h: Column, kappa: Column, hex_fit: Column, tet_fit: Column, poly_fit: Column) -> Column:
    """The spread of the fits; at least 0.35 where a curved element (turn above 0.05) fits a hexahedron badly (below 0.4)."""
    spread = _unit(F.greatest(hex_fit, tet_fit, poly_fit) - F.least(hex_fit, tet_fit, poly_fit))
    curved = (hex_fit < 0.4) & (kappa > 0) & (h > 0) & (h * kappa > 0.05)
    return F.when(curved, F.greatest(spread, F.lit(0.35))).otherwise(spread)


def decide(h: Column, kappa: Column, thickness: Column, eta: Column, surplus: Column, p: Column, p_max: Column, hex_fit: Column, tet_fit: Column, poly_fit: Column, max_eta: Column, policy: Policy = Policy()) -> dict[str, Column]:
    """utility_h, utility_p, utility_shape, action, reason, and h_next, p_next and shape that follow."""
    zero = F.lit(0.0)
    error, top = F.greatest(eta, zero), F.greatest(max_eta, zero)
    severity = geometry_severity(h, kappa, thickness, policy)
    gated = severity >= policy.gate
    ratio = F.greatest(surplus, zero) / F.greatest(error, F.lit(1e-30))
    smooth = _unit(ratio / policy.smooth_ratio)
    floor = F.greatest(top, F.lit(1e-6))
    by_geometry = F.when(gated, severity * F.greatest(error, 0.1 * floor)).otherwise(zero)
    by_error = F.when(gated, zero).otherwise(error * (1 - smooth) * (1 - smooth))
    raise_p = ~gated & (p < p_max) & (p_max > 0) & (ratio >= policy.smooth_ratio / 2)
    gain_p = F.when(raise_p, error * smooth * smooth * (1 - 0.15 * p)).otherwise(zero)
    vote = shape_vote(hex_fit, tet_fit, poly_fit)
    gain_s = awkwardness(h, kappa, hex_fit, tet_fit, poly_fit) * F.greatest(error, 0.05 * floor) * F.when(gated, 0.25).otherwise(1.0)
    idle = F.when(~(h > 0) | (p < 1), "invalid").when((top > 0) & (error < policy.noise_floor * top), "floor").when((error <= 0) & ~gated, "zero-eta")
    active = lambda x: F.when(idle.isNull(), x).otherwise(zero)
    u_h = active(F.greatest(by_geometry, by_error) / policy.cost_h)
    u_p = active(gain_p / (policy.cost_p + policy.cost_p_order * F.greatest(p, F.lit(1))))
    u_s = active(F.when(vote == "keep", zero).otherwise(gain_s / policy.cost_shape))
    act = F.when(idle.isNotNull() | (F.greatest(u_h, u_p, u_s) < policy.least_utility), "none").when((u_h >= u_p) & (u_h >= u_s), "h").when(u_p >= u_s, "p").otherwise("shape")
    why = F.when(act == "h", F.when(by_geometry >= by_error, "geometry-h").otherwise("nonsmooth-h")).when(act == "p", "smooth-p").when(act == "shape", "shape-fit").otherwise(F.coalesce(idle, F.lit("low-utility")))
    return {
        "utility_h": u_h, "utility_p": u_p, "utility_shape": u_s, "action": act, "reason": why,
        "h_next": F.when(act == "h", F.greatest(h * policy.refine, F.lit(policy.h_min))).otherwise(h), "p_next": F.when(act == "p", p + 1).otherwise(p), "shape": F.when(act == "shape", vote).otherwise("keep"),
    }


def surplus_from_marks(eta: Column, marked: Column) -> Column:
    """Smooth elements would gain their whole error from the next order, marked ones a tenth."""
    return F.greatest(eta, F.lit(0.0)) * F.when(marked, 0.1).otherwise(1.0)


def dof_factor(share_h: Column, share_p: Column, share_shape: Column, policy: Policy = Policy()) -> Column:
    """Predicted growth of the unknowns from the shares of elements that change."""
    return 1 + share_h * (policy.cost_h - 1) + share_p * (policy.cost_p - 1) + share_shape * 0.25 * (policy.cost_shape - 1)


def next_size(h: Column, share_marked: Column, policy: Policy = Policy()) -> Column:
    """A uniform size for the next pass: unchanged below a twentieth of marked elements."""
    return F.when(share_marked < 0.05, h).otherwise(F.greatest(h * policy.refine, F.lit(policy.h_min)))
