"""Writers: run logs, single documents, reports, mesh files.

Tables go through Spark's committers.  Single documents and mesh files are products
for people and viewers: their rows are streamed through the driver into the file, a
partition at a time, never held whole.
"""

from __future__ import annotations

import contextlib
import json
import os
import struct
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meshes import VTK_TYPES


def append_line(path: str, record: dict) -> None:
    """One JSON line at the end of a local log, on disk when the call returns: what a runner writes after each run."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")
        f.flush()
        os.fsync(f.fileno())


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def write_warehouse(runs: DataFrame, path: str) -> None:
    """Partitioned by configuration, part and tier, so readers prune by folder."""
    runs.write.mode("append").partitionBy("cfg_id", "part", "tier").parquet(path)


def atomic_write(path: str, text: str | bytes) -> None:
    """A temporary file beside the target, renamed over it."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)
    os.replace(temporary, path)


@contextlib.contextmanager
def atomic_file(path: str):
    """A binary file beside the target, renamed over it at the end; removed on failure."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "wb") as f:
            yield f
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_document(path: str, fields: dict) -> None:
    """Checkpoint, progress or handoff JSON."""
    atomic_write(path, json.dumps(fields, sort_keys=True, indent=1))


def ranking_report(ranked: DataFrame, front: DataFrame, levels: DataFrame, name: str) -> tuple[str, str]:
    """(JSON, Markdown) of a campaign's ranking, front and factor levels: all rows in the JSON, the first 1000 of each and the number left out in the Markdown."""
    tables = {k: [r.asDict(recursive=True) for r in df.toLocalIterator()] for k, df in (("ranking", ranked), ("pareto", front), ("factors", levels))}
    lines = [f"# {name}", ""]
    for title, rows in tables.items():
        lines += [f"## {title}", ""]
        if rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0])]
            lines += ["| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |" for r in rows[:1000]]
        if len(rows) > 1000:
            lines += ["", f"{len(rows) - 1000} more rows follow in the JSON."]
        lines.append("")
    return json.dumps({"campaign": name} | tables, default=str), "\n".join(lines)


def svg_sparkline(values: list[float], width: int = 120, height: int = 24) -> str:
    """A polyline scaled to the box; a flat series lies in its middle."""
    low, high = min(values, default=0), max(values, default=0)
    step = width / max(1, len(values) - 1)
    points = " ".join(f"{i * step:.1f},{height / 2 if high == low else height - (v - low) / (high - low) * height:.1f}" for i, v in enumerate(values))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def scoreboard(results: DataFrame) -> str:
    """Markdown of all competitive results in the order of time, solver and case."""
    rows = results.orderBy("timestamp", "solver", "case_id").toLocalIterator()
    head = "| timestamp | solver | case | dofs | total s | accuracy |\n|---|---|---|---|---|---|\n"
    return head + "\n".join(f"| {r['timestamp']} | {r['solver']} | {r['case_id']} | {r['dofs'] or '-'} | {(r['wall_time_s'] or {})['total'] if r['wall_time_s'] else '-'} | {r['accuracy']['value'] if r['accuracy'] else '-'} |" for r in rows) + "\n"


def write_vtu(nodes: DataFrame, elements: DataFrame, path: str, point_fields: tuple[str, ...] = ()) -> None:
    """ASCII VTU of dense ids: nodes (nid, x, y, z, fields) and elements (eid, etype, nodes).  Each array is one pass over its table."""
    n, last = nodes.agg(F.count("*"), F.max("nid")).first()
    if n and (last != n - 1 or nodes.select("nid").distinct().count() != n):
        raise ValueError("node ids must be dense from 0")
    pts, cells = nodes.orderBy("nid"), elements.orderBy("eid")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in VTK_TYPES.items() for x in kv]), F.col("etype"))

    def array(f, type_: str, name: str, rows, count: int = 1) -> None:
        f.write(f'<DataArray type="{type_}" Name="{name}" NumberOfComponents="{count}" format="ascii">'.encode())
        for r in rows:
            f.write(f"{r} ".encode())
        f.write(b"</DataArray>")

    def offsets():
        total = 0
        for r in cells.select(F.size("nodes").alias("n")).toLocalIterator():
            total += r["n"]
            yield total

    with atomic_file(path) as f:
        f.write(f'<VTKFile type="UnstructuredGrid" version="0.1"><UnstructuredGrid><Piece NumberOfPoints="{n}" NumberOfCells="{elements.count()}"><PointData>'.encode())
        for name in point_fields:
            array(f, "Float64", name, (repr(float(r[0])) for r in pts.select(name).toLocalIterator()))
        f.write(b"</PointData><Points>")
        array(f, "Float64", "Points", (f"{r['x']!r} {r['y']!r} {r['z']!r}" for r in pts.select("x", "y", "z").toLocalIterator()), 3)
        f.write(b"</Points><Cells>")
        array(f, "Int64", "connectivity", (" ".join(map(str, r["nodes"])) for r in cells.select("nodes").toLocalIterator()))
        array(f, "Int64", "offsets", offsets())
        array(f, "UInt8", "types", (r[0] for r in cells.select(kind).toLocalIterator()))
        f.write(b"</Cells></Piece></UnstructuredGrid></VTKFile>")


def write_preview(nodes: DataFrame, quads: DataFrame, n_elements: int, path: str) -> None:
    """PMP1: magic, counts, float32 coordinates, uint32 quads."""
    with atomic_file(path) as f:
        f.write(b"PMP1" + struct.pack("<IIQ", nodes.count(), quads.count(), n_elements))
        for r in nodes.orderBy("nid").select("x", "y", "z").toLocalIterator():
            f.write(struct.pack("<3f", *r))
        for r in quads.orderBy("qid").select("nodes").toLocalIterator():
            f.write(struct.pack("<4I", *r["nodes"]))


def diagnostics(elements: DataFrame, mesh_ms: float, solve_ms: float, n_dof: int) -> dict:
    """Quality over elements with a positive value, times and throughput."""
    r = elements.agg(F.min(F.when(F.col("quality") > 0, F.col("quality"))).alias("q_min"), F.avg(F.when(F.col("quality") > 0, F.col("quality"))).alias("q_mean"), F.count("*").alias("n")).first()
    return {"quality_min": r["q_min"], "quality_mean": r["q_mean"], "n_elements": r["n"], "mesh_ms": mesh_ms, "solve_ms": solve_ms, "elements_per_s": r["n"] / (mesh_ms / 1000) if mesh_ms else None, "dof_per_s": n_dof / (solve_ms / 1000) if solve_ms else None}


def trend_rows(runs: DataFrame) -> DataFrame:
    """The handoff's table of runs by part, mesher and tier."""
    return runs.select("part", F.col("config")["mesher"].alias("mesher"), "tier", "status", "accuracy.rel_err", "mesh_ms", "solve_ms").orderBy("part", "mesher", "tier")


def scoreboard_rows(results: DataFrame, headlines: list[str], summary: dict | None = None) -> DataFrame:
    """Headline results (case_id, solver, label, dofs, metric, value, unit, total_s, notes) and, for a summary of a pair of runs, a row for each of its ratios."""
    found = results.filter(F.col("case_id").isin(headlines))
    if not summary:
        return found
    names = {"dof_ratio": "unknowns, uniform over graded", "time_ratio": "total time, uniform over graded"}
    rows = [(summary["case_id"], summary["solver"], summary["label"], summary["dofs"], k, float(summary[k]), "ratio", float(summary["total_s"]), text) for k, text in names.items() if summary.get(k) is not None]
    noted = found.withColumn("notes", F.concat_ws("; ", "notes", *[F.lit(f"{k}={summary[k]}") for k in names if summary.get(k) is not None]))
    return noted.unionByName(results.sparkSession.createDataFrame(rows, noted.select(*_SCORE).schema))


_SCORE = ("case_id", "solver", "label", "dofs", "metric", "value", "unit", "total_s", "notes")


def constant_rows(spark, rows: list[dict]) -> DataFrame:
    """Results that are stated, not run, in the columns of ``scoreboard_rows``."""
    schema = "case_id string, solver string, label string, dofs long, metric string, value double, unit string, total_s double, notes string"
    return spark.createDataFrame([tuple(r.get(c) for c in _SCORE) for r in rows], schema)


def pareto_points(runs: DataFrame) -> DataFrame:
    """(cfg_id, part, accuracy, total_ms) of the runs that are done, for a front over single runs."""
    ok = runs.filter("status = 'ok' AND accuracy.score IS NOT NULL")
    return ok.select("cfg_id", "part", F.col("accuracy.score").alias("accuracy"), (F.coalesce("mesh_ms", F.lit(0.0)) + F.coalesce("solve_ms", F.lit(0.0))).alias("total_ms"))
