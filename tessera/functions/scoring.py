"""Scores, labels and classifications of experiment runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The relative error that halves a score, the weights a campaign has by default.
HALF_ERROR = 0.05
WEIGHTS = {"accuracy": 0.5, "solve_ms": 0.25, "mesh_ms": 0.25}
#: Wall-clock limits in seconds by tier (the last holds from there on).
WALL_LIMITS = (900.0, 900.0, 2700.0)
#: Budgets of a run.
MAX_DOF, MAX_ELEMENTS = 80_000, 60_000


def accuracy(status: Column, score: Column, rel_err: Column) -> Column:
    """0 for a failed run; else its score; else 1 / (1 + |relative error| / 0.05); else 0."""
    return F.when(status != "ok", F.lit(0.0)).otherwise(F.coalesce(score, 1 / (1 + F.abs(rel_err) / HALF_ERROR), F.lit(0.0)))


def soft_time(ms: Column) -> Column:
    """1 at no time, a half at one second."""
    return 1 / (1 + ms / 1000)


def run_score(accuracy: Column, solve_ms: Column, mesh_ms: Column, ok: Column, failure: str = "time_credit", weights: dict[str, float] | None = None) -> Column:
    """Weighted score.  A failed run has accuracy 0 ("time_credit") or scores 0 outright ("zero")."""
    w = WEIGHTS | (weights or {})
    times = w["solve_ms"] * soft_time(solve_ms) + w["mesh_ms"] * soft_time(mesh_ms)
    good = w["accuracy"] * accuracy + times
    if failure == "zero":
        return F.when(ok, good).otherwise(F.lit(0.0))
    return F.when(ok, good).otherwise(times)


def relative_error(measured: Column, truth: Column) -> Column:
    """|m - t| / |t|, or |m| where the truth is 0."""
    return F.when(truth == 0, F.abs(measured)).otherwise(F.abs(measured - truth) / F.abs(F.nullif(truth, F.lit(0.0))))


def metric_score(rel_err: Column, tol: Column, healthy: Column) -> Column:
    return F.when(healthy, 1 / (1 + rel_err / F.coalesce(tol, F.lit(0.05)))).otherwise(F.lit(0.0))


def healthy(orphans: Column, residual: Column, reaction: Column, area_ok: Column) -> Column:
    """No orphan node, residual at most 1e-6, reaction error at most 0.05, load area right."""
    return (orphans == 0) & (residual <= 1e-6) & (reaction <= 0.05) & area_ok


def predicted_elements(volume: Column, h: Column) -> Column:
    return 6 * volume / (h * h * h)


def over_budget(predicted: Column, n_dof: Column, n_elements: Column, wall_s: Column, wall_limit: Column) -> Column:
    """Why a run is over budget, or null.

    A prediction of more than twice the elements allowed is the sizing's fault; a mesh
    over a limit is the mesher's where it has over three times the prediction, else
    the budget's; then comes time.
    """
    large = (n_dof > MAX_DOF) | (n_elements > MAX_ELEMENTS)
    runaway = (predicted > 0) & (n_elements > 3 * predicted)
    return F.when(predicted > 2 * MAX_ELEMENTS, "sizing").when(large & runaway, "mesher").when(large, "budget").when(wall_s > wall_limit, "wall_clock")


def curved_fraction(n_triangles: Column) -> Column:
    """(triangles - 12) / triangles, clamped to 0..1: a box has 12."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n_triangles - 12) / F.greatest(n_triangles, F.lit(1))))


def geometry_class(thin: Column, curved: Column) -> Column:
    return F.when(thin, "thin_wall").when(curved >= 0.25, "curved").when(curved >= 0.05, "mild_curve").otherwise("prismatic")


def config_label(config: Column) -> Column:
    """A map as sorted "k=v, ..."."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def canonical_json(config: Column) -> Column:
    """A map of strings as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))


def config_id(text: Column) -> Column:
    """cfg-%08x of the low half of the 64-bit FNV-1a hash of the UTF-8 bytes.

    The low half of a product needs the low halves only, so BIGINT never overflows.
    """
    code = F.hex(F.encode(text, "utf-8"))
    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1)))
    byte = lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    h = F.aggregate(steps, F.lit(0x84222325).cast("long"), lambda acc, i: F.pmod(acc.bitwiseXOR(F.coalesce(byte(i), F.lit(0))) * 435, F.lit(1 << 32)))
    h = F.when(F.octet_length(text) == 0, F.lit(0x84222325).cast("long")).otherwise(h)
    return F.concat(F.lit("cfg-"), F.lpad(F.lower(F.hex(h)), 8, "0"))


def level_value(text: Column) -> Column:
    """A level's text as (kind, number): booleans 0/1, integers and floats their value, else no number."""
    boolean = F.lower(text).isin("true", "false")
    number = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    whole = F.regexp_like(text, F.lit("^[+-]?[0-9]+$"))
    kind = F.when(boolean, "bool").when(whole, "int").when(number.isNotNull(), "float").otherwise("str")
    value = F.when(boolean, (F.lower(text) == "true").cast("double")).otherwise(number)
    return F.struct(kind.alias("kind"), value.alias("number"))


def wall_limit(tier: Column, override: Column) -> Column:
    out = F.lit(WALL_LIMITS[-1])
    for i, limit in reversed(list(enumerate(WALL_LIMITS[:-1]))):
        out = F.when(tier == i, F.lit(limit)).otherwise(out)
    return F.coalesce(override, out)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def milliseconds(ms: Column) -> Column:
    """Whole milliseconds below a second, then seconds with two places, from ten seconds on with one."""
    return F.when(ms >= 10000, F.format_string("%.1fs", ms / 1000)).when(ms >= 1000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%.0fms", ms))


def run_state(text: Column, known: tuple[str, ...] = ("ok", "solve_suspect", "mesh_fail", "solve_fail", "over_budget")) -> Column:
    return F.when(text.isin(*known), text).otherwise("unknown")


#: Names a mesher goes by.
MESHERS = {
    "hex": ("hex",), "tet": ("tet", "tet_fill"), "graded_tet": ("graded_tet", "graded"), "hybrid": ("hybrid_zoo", "hybrid", "zoo"), "hybrid_vem": ("hybrid_vem", "hybridvem", "hybrid-vem"), "hexpyr": ("hexpyr", "transition"),
    "prism": ("prism", "sweep"), "hexvem": ("hexvem", "vem"), "octa": ("octa", "octahedral"), "varyhedron": ("varyhedron", "vary"), "cvt_poly": ("cvt_poly", "cvt", "restricted_cvt"),
}


def mesher(name: Column) -> Column:
    """The mesher of a name; an unknown name fails."""
    out = None
    for own, names in MESHERS.items():
        test = name.isin(*names)
        out = F.when(test, own) if out is None else out.when(test, own)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown mesher "), name)))


def tendency(base: Column, t: Column, skin_layers: Column) -> tuple[Column, Column]:
    """(mesher, skin layers) after the shape dial -1..1; exactly 0 keeps the base, as do meshers outside the three families."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t))
    layers = F.greatest(F.lit(1), skin_layers)
    dialled = base.isin("hybrid", "hybrid_vem", "hex", "hexvem", "tet", "graded_tet", "varyhedron")
    idle = F.abs(x) < 1e-12
    to = F.when(x <= -0.5, "hex").when(x <= 0.25, "hybrid").when(x <= 0.75, "hybrid_vem").otherwise("graded_tet")
    own = F.when(idle | ~dialled, base).otherwise(to)
    skin = F.when(idle, layers).when((own == "hybrid") & (x < 0), F.greatest(F.lit(1), skin_layers - 1)).when((own == "graded_tet") & (x > 0.75), skin_layers + 1).otherwise(layers)
    return own, skin


#: Kinds of probes by the answer they read, and those that divide by a nominal value.
PROBES = {
    "sigma_face_mean": ("mean_vm", "mean_von_mises", "face_mean_vm"), "sigma_max": ("max_von_mises", "max_vm"), "sigma_p99": ("sigma_p99", "p99_vm"),
    "strain_energy": ("strain_energy", "energy"), "tip_deflection": ("max_displacement", "tip_deflection"),
}
RATIOS = {"sigma_face_mean": ("mean_vm_over_nominal", "scf_mean", "scf"), "sigma_max": ("max_vm_over_nominal",)}
FACE_MEANS = {"mean_ux_on_face": (0, "mean_ux"), "mean_uz_on_face": (2, "mean_uz")}


def probe(kind: Column, nominal: Column, answers: dict[str, Column]) -> Column:
    """The measured value of a probe; a ratio without a nominal value and an unknown kind fail."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, kinds in PROBES.items():
        out = out.when(kind.isin(*kinds), answers[name])
    missing = F.raise_error(F.concat(kind, F.lit(" needs a nominal value"))).cast("double")
    for name, kinds in RATIOS.items():
        out = out.when(kind.isin(*kinds), F.when(F.coalesce(F.abs(nominal) > 0, F.lit(False)), answers[name] / F.nullif(nominal, F.lit(0.0))).otherwise(missing))
    for own, (axis, name) in FACE_MEANS.items():
        out = out.when(kind == own, F.when(answers["dominant_load_axis"] == axis, answers["mean_u_component"]).otherwise(answers[name]))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown probe kind "), kind)).cast("double"))
