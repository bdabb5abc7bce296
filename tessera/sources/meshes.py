"""Mesh files (STL, MSH 2.2, VTU, PMP1) as tables.

Files are read as ``binaryFile`` rows, one file a task, and parsed in mapInPandas;
a folder of many files is read in parallel.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Element codes of MSH 2.2 and cell codes of VTU.
MSH_TYPES = {4: ("tet4", 4), 5: ("hex8", 8), 6: ("prism6", 6), 7: ("pyramid5", 5), 11: ("tet10", 10), 17: ("hex20", 20)}
VTK_TYPES = {"tet4": 10, "hex8": 12, "prism6": 13, "pyramid5": 14, "tet10": 24, "hex20": 25, "poly": 42}


def _parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(parse(p, bytes(content)), columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def is_ascii_stl(data: bytes) -> bool:
    """Begins with "solid" and names a facet in the first kilobyte."""
    return data[:5].lower() == b"solid" and b"facet" in data[:1024]


def stl_triangles(data: bytes) -> np.ndarray:
    """n x 9 coordinates; fails on a truncated file."""
    if is_ascii_stl(data):
        v = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
        if len(v) % 3:
            raise ValueError("an ASCII STL facet lacks a vertex")
        return np.array(v, dtype="S").astype(float).reshape(-1, 9)
    if len(data) < 84:
        raise ValueError("a binary STL has a header of 84 bytes")
    n = struct.unpack_from("<I", data, 80)[0]
    if len(data) < 84 + 50 * n:
        raise ValueError("the binary STL is truncated")
    rows = np.frombuffer(data, np.dtype([("f", "<f4", 12), ("a", "<u2")]), n, 84)
    return rows["f"][:, 3:].astype(float)


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """Triangle soup: path, tid, c (nine coordinates)."""
    return _parsed(spark, path, lambda p, d: [(p, i, c.tolist()) for i, c in enumerate(stl_triangles(d))], "path string, tid long, c array<double>")


def msh_sections(data: bytes) -> dict[str, list[str]]:
    text = data.decode("utf-8", "replace")
    found = {m[1]: m[2].strip().splitlines() for m in re.finditer(r"\$(\w+)\s*\n(.*?)\$End\1", text, re.S)}
    if "MeshFormat" not in found:
        raise ValueError("no $MeshFormat section")
    version, kind = found["MeshFormat"][0].split()[:2]
    if not version.startswith("2.") or kind != "0":
        raise ValueError("only ASCII MSH 2.x is read")
    return found


def parse_msh(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(nodes with file id and coordinates, volume elements with tag, type and file ids)."""
    s = msh_sections(data)
    nodes, seen = [], set()
    for line in s["Nodes"][1:]:
        i, x, y, z = line.split()[:4]
        if int(i) in seen:
            raise ValueError(f"node {i} is defined twice")
        seen.add(int(i))
        nodes.append((int(i), float(x), float(y), float(z)))
    elements = []
    for line in s["Elements"][1:]:
        f = list(map(int, line.split()))
        if f[1] in MSH_TYPES:
            name, n = MSH_TYPES[f[1]]
            refs = f[3 + f[2] : 3 + f[2] + n]
            if len(refs) < n or not seen.issuperset(refs):
                raise ValueError(f"element {f[0]} names an unknown node")
            elements.append((f[0], name, f[3] if f[2] else 0, refs))
    if not elements:
        raise ValueError("no volume element")
    return nodes, elements


def read_msh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: path, file_id, nid, x, y, z; elements: path, eid, etype, tag, nodes), ids dense from 0 in file order."""

    def nodes(p, d):
        return [(p, i, k, x, y, z) for k, (i, x, y, z) in enumerate(parse_msh(d)[0])]

    def elements(p, d):
        found, own = parse_msh(d)
        dense = {i: k for k, (i, *_) in enumerate(found)}
        return [(p, k, e, t, [dense[r] for r in refs]) for k, (_, e, t, refs) in enumerate(own)]

    return _parsed(spark, path, nodes, "path string, file_id long, nid long, x double, y double, z double"), _parsed(spark, path, elements, "path string, eid long, etype string, tag int, nodes array<long>")


def vtu_array(text: str, name: str) -> list[str]:
    m = re.search(rf'<DataArray[^>]*Name="{name}"[^>]*>(.*?)</DataArray>', text, re.S)
    return m[1].split() if m else []


def parse_vtu(data: bytes) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Points, cells (from connectivity and offsets) and cell codes of an ASCII VTU."""
    text = data.decode()
    points = re.search(r"<Points>.*?<DataArray[^>]*>(.*?)</DataArray>", text, re.S)[1].split()
    link, ends = list(map(int, vtu_array(text, "connectivity"))), list(map(int, vtu_array(text, "offsets")))
    return np.array(points, float).reshape(-1, 3), [link[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], list(map(int, vtu_array(text, "types")))


def read_vtu(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points: path, nid, x, y, z; cells: path, eid, vtk_type, nodes)."""

    def points(p, d):
        return [(p, i, *map(float, xyz)) for i, xyz in enumerate(parse_vtu(d)[0])]

    def cells(p, d):
        _, own, types = parse_vtu(d)
        return [(p, i, t, c) for i, (c, t) in enumerate(zip(own, types, strict=True))]

    return _parsed(spark, path, points, "path string, nid long, x double, y double, z double"), _parsed(spark, path, cells, "path string, eid long, vtk_type int, nodes array<long>")


MOST_PREVIEW_ROWS = 50_000_000


def parse_preview(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(elements, node coordinates, quads) of a PMP1 preview; fails on another magic, absurd counts or a short file."""
    if data[:4] != b"PMP1" or len(data) < 20:
        raise ValueError("not a PMP1 preview")
    n, q, elements = struct.unpack_from("<IIQ", data, 4)
    if n > MOST_PREVIEW_ROWS or q > MOST_PREVIEW_ROWS or len(data) < 20 + 12 * n + 16 * q:
        raise ValueError("the PMP1 preview is truncated or its counts are absurd")
    return elements, np.frombuffer(data, "<f4", 3 * n, 20).reshape(-1, 3).astype(float), np.frombuffer(data, "<u4", 4 * q, 20 + 12 * n).reshape(-1, 4).astype(np.int64)


def read_preview(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: path, nid, x, y, z; quads: path, qid, nodes)."""
    return (
        _parsed(spark, path, lambda p, d: [(p, i, *map(float, r)) for i, r in enumerate(parse_preview(d)[1])], "path string, nid long, x double, y double, z double"),
        _parsed(spark, path, lambda p, d: [(p, i, r.tolist()) for i, r in enumerate(parse_preview(d)[2])], "path string, qid long, nodes array<long>"),
    )
