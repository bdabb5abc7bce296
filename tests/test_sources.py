"""Readers and writers on small files of the documented shapes."""

import json
import struct

import pytest

from tessera.sources import meshes, records, sinks

RUN = {"cfg_id": "cfg-1", "part": "p", "tier": 0, "status": "ok", "config": {"mesher": "m"}, "mesh_ms": 1.0, "solve_ms": 2.0, "accuracy": {"metric": "x", "score": 0.5, "rel_err": 0.1}, "geom_class": {"curved_frac": 0.1, "thin": False}}


def lines(tmp_path, *texts, name="results.jsonl"):
    (tmp_path / name).write_text("\n".join(texts) + "\n")
    return str(tmp_path / name)


def test_run_log_modes(spark, tmp_path):
    good = json.dumps(RUN)
    path = lines(tmp_path, good, "", '{"cfg_id": "cut', json.dumps({"cfg_id": "cfg-2", "part": "p", "tier": 1, "status": "over_budget", "error": "e"}), '{"part": "no key"}')
    warn = records.run_log(spark, path).cache()
    assert warn.filter("_corrupt IS NOT NULL").count() == 1 and warn.count() == 4
    skip = records.run_log(spark, path, "skip")
    assert sorted(r["cfg_id"] for r in skip.collect()) == ["cfg-1", "cfg-2"]
    assert records.completed(skip.unionByName(skip)).count() == 2
    strict = lines(tmp_path, good + " \t\r", "  # comment", "", good, name="s.jsonl")
    assert records.run_log(spark, strict, "strict").count() == 2
    assert records.count_lines(spark, strict) == 2
    with pytest.raises(Exception):
        records.run_log(spark, lines(tmp_path, good, "{bad", name="b.jsonl"), "strict").collect()


def test_documents_and_cases(spark, tmp_path):
    c = {"name": "n", "parts": ["a"], "tiers": [{"h_scale": 1.0, "keep_frac": 0.5}], "grid": {"m": ["1", "2"]}}
    doc = records.document(spark, lines(tmp_path, json.dumps(c, indent=1), name="campaign.json"), records.CAMPAIGN)
    assert records.valid_campaign(doc).first()["name"] == "n"
    bad = records.document(spark, lines(tmp_path, json.dumps(c | {"tiers": [{"keep_frac": 0.0}]}), name="bad.json"), records.CAMPAIGN)
    with pytest.raises(Exception):
        records.valid_campaign(bad).collect()
    case = {"part": "p", "bcs": [{"select": {"box": [[0, 0, 0], [1, 1, 1]]}, "fix": [True, True, True]}], "loads": [{"select": {"box": [[0, 0, 0], [1, 1, 1]], "expected_area": 2.0}, "traction": [1, 0, 0]}]}
    df = records.document(spark, lines(tmp_path, json.dumps(case), name="case.json"), records.CASE)
    assert records.case_rows(df, "loads").first()["hi"] == [1.0, 1.0, 1.0] and records.case_rows(df, "bcs").count() == 1
    m = records.document(spark, lines(tmp_path, json.dumps({"part": "p", "metrics": [{"name": "a", "value": 1.0}, {"name": "b", "value": 2.0, "tol": 0.1}]}), name="m.json"), records.METRICS)
    assert [(r["name"], r["tol"]) for r in records.metric_rows(m).collect()] == [("a", 0.05), ("b", 0.1)]


def test_result_files(spark, tmp_path):
    r = {"solver": "s", "case_id": "c", "label": "l", "timestamp": "t", "dofs": 3}
    for name, doc in (("one", r), ("list", [r, r]), ("nested", {"results": [r, r, r]})):
        got = records.result_files(spark, lines(tmp_path, json.dumps(doc), name=f"{name}.json"))
        assert got.count() == {"one": 1, "list": 2, "nested": 3}[name]
        assert "| s | c | 3 |" in sinks.scoreboard(got)
    with pytest.raises(Exception):
        records.result_files(spark, lines(tmp_path, json.dumps({"solver": "s"}), name="x.json")).collect()


def test_campaign_scan_and_text(spark, tmp_path):
    for n, own in (("b", None), ("a", "zeta")):
        (tmp_path / n).mkdir()
        if own:
            (tmp_path / n / "campaign.json").write_text(json.dumps({"name": own}))
        (tmp_path / n / "checkpoint.json").write_text(json.dumps({"state": "done"}))
        lines(tmp_path / n, json.dumps(RUN), "", "# c", json.dumps(RUN))
    got = records.scan_campaigns(spark, str(tmp_path)).collect()
    assert [(r["name"], r["state"], r["n_results"], r["has_campaign"], r["has_progress"]) for r in got] == [("b", "done", 2, False, False), ("zeta", "done", 2, True, False)]
    text = spark.createDataFrame([("f", i, x) for i, x in enumerate(["- id: A", "  status: todo", "- id: B", "  status: done", "- id: C", "  note", "  status: in_progress"])], "file string, n int, value string")
    assert sorted(r["id"] for r in records.open_program_nodes(text).collect()) == ["A", "C"]
    from pyspark.sql import functions as F

    assert spark.range(1).select(*records.mesh_counts(F.lit("made 12 elem and 30 nodes"))).first()[:] == (12, 30)
    assert records.matching_lines(spark, [str(tmp_path / "a" / "results.jsonl")], "cfg_id").count() == 2


ASCII = "solid t\n" + "".join(f"facet normal 0 0 1\nouter loop\nvertex 0 0 {i}\nvertex 1 0 {i}\nvertex 0 1 {i}\nendloop\nendfacet\n" for i in range(2)) + "endsolid"


def test_stl(spark, tmp_path):
    (tmp_path / "a.stl").write_text(ASCII)
    tri = struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    (tmp_path / "b.stl").write_bytes(b"solid but binary".ljust(80) + struct.pack("<I", 1) + tri)
    got = meshes.read_stl(spark, str(tmp_path / "*.stl")).collect()
    assert len(got) == 3 and all(len(r["c"]) == 9 for r in got)
    for bad in (b"x" * 50, b"\0" * 80 + struct.pack("<I", 9) + tri):
        with pytest.raises(ValueError):
            meshes.stl_triangles(bad)


MSH = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n5\n10 0 0 0\n20 1 0 0\n30 0 1 0\n40 0 0 1\n50 1 1 1\n$EndNodes\n$Elements\n2\n1 2 2 7 7 10 20 30\n2 4 2 9 9 10 20 30 40\n$EndElements\n"


def test_msh(spark, tmp_path):
    (tmp_path / "m.msh").write_text(MSH)
    nodes, elements = meshes.read_msh(spark, str(tmp_path / "m.msh"))
    assert nodes.count() == 5 and elements.first()["nodes"] == [0, 1, 2, 3] and elements.first()["tag"] == 9
    for a, b in (("2.2 0 8", "4.1 0 8"), ("2.2 0 8", "2.2 1 8"), ("20 1 0 0", "10 1 0 0"), ("30 40\n", "30 99\n"), ("2 4 2 9 9 10 20 30 40\n", "")):
        with pytest.raises(ValueError):
            meshes.parse_msh(MSH.replace(a, b).encode())


def test_vtu_and_preview_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(i, float(i), 0.5, -1.0) for i in range(5)], "nid long, x double, y double, z double")
    elements = spark.createDataFrame([(0, "tet4", [0, 1, 2, 3]), (1, "pyramid5", [0, 1, 2, 3, 4])], "eid long, etype string, nodes array<long>")
    sinks.write_vtu(nodes, elements, str(tmp_path / "o.vtu"))
    pts, cells = meshes.read_vtu(spark, str(tmp_path / "o.vtu"))
    assert [r["x"] for r in pts.orderBy("nid").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert [(r["vtk_type"], r["nodes"]) for r in cells.orderBy("eid").collect()] == [(10, [0, 1, 2, 3]), (14, [0, 1, 2, 3, 4])]
    quads = spark.createDataFrame([(0, [0, 1, 2, 2])], "qid long, nodes array<long>")
    sinks.write_preview(nodes, quads, 2, str(tmp_path / "o.pmp"))
    p, q = meshes.read_preview(spark, str(tmp_path / "o.pmp"))
    assert p.count() == 5 and q.first()["nodes"] == [0, 1, 2, 2]
    for bad in (b"PMP2" + b"\0" * 40, b"PMP1" + struct.pack("<IIQ", 9, 9, 9)):
        with pytest.raises(ValueError):
            meshes.parse_preview(bad)


def test_sinks(spark, tmp_path):
    runs = spark.read.schema(records.RUN_SCHEMA).json(lines(tmp_path, json.dumps(RUN)))
    sinks.append_runs(runs, str(tmp_path / "log"))
    sinks.append_runs(runs, str(tmp_path / "log"))
    assert records.run_log(spark, str(tmp_path / "log"), "skip").count() == 2
    sinks.write_warehouse(runs, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).filter("tier = 0").count() == 1
    sinks.write_document(str(tmp_path / "c.json"), {"state": "done"})
    assert json.loads((tmp_path / "c.json").read_text()) == {"state": "done"}
    assert "<polyline" in sinks.svg_sparkline([1.0, 2.0, 3.0]) and sinks.trend_rows(runs).count() == 1
    q = spark.createDataFrame([(0.5,), (0.0,), (1.0,)], "quality double")
    assert sinks.diagnostics(q, 1000.0, 500.0, 10) == {"quality_min": 0.5, "quality_mean": 0.75, "n_elements": 3, "mesh_ms": 1000.0, "solve_ms": 500.0, "elements_per_s": 3.0, "dof_per_s": 20.0}
    a = spark.createDataFrame([("c", 1.0)], "cfg string, s double")
    js, md = sinks.ranking_report(a, a, a, "camp")
    assert json.loads(js)["ranking"] == [{"cfg": "c", "s": 1.0}] and "# camp" in md


def test_reports_hold_all_rows(spark):
    from pyspark.sql import functions as F

    own = spark.range(1200).select(F.lit("s").alias("solver"), F.col("id").cast("string").alias("case_id"), F.format_string("%05d", "id").alias("timestamp"), F.col("id").alias("dofs"), F.lit(None).cast("struct<total:double>").alias("wall_time_s"), F.lit(None).cast("struct<value:double>").alias("accuracy"))
    board = sinks.scoreboard(own).splitlines()
    assert len(board) == 1202 and board[-1].startswith("| 01199 |")
    a = spark.range(1200)
    js, md = sinks.ranking_report(a, a.limit(1), a.limit(0), "camp")
    assert len(json.loads(js)["ranking"]) == 1200 and md.count("200 more rows follow in the JSON.") == 1
