"""SQL functions and table functions of the library, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Temporary SQL functions: name, parameters, type, body.  They are expanded into the query's plan, no worker runs.
FUNCTIONS = (
    ("soft_time", "ms DOUBLE", "DOUBLE", "1 / (1 + ms / 1000)"),
    ("relative_error", "measured DOUBLE, truth DOUBLE", "DOUBLE", "CASE WHEN truth = 0 THEN abs(measured) ELSE abs(measured - truth) / abs(nullif(truth, 0)) END"),
    ("predicted_elements", "volume DOUBLE, h DOUBLE", "DOUBLE", "6 * volume / (h * h * h)"),
    ("curved_fraction", "n INT", "DOUBLE", "greatest(0D, least(1D, (n - 12) / CAST(greatest(n, 1) AS DOUBLE)))"),
    ("geometry_class", "thin BOOLEAN, curved DOUBLE", "STRING", "CASE WHEN thin THEN 'thin_wall' WHEN curved >= 0.25 THEN 'curved' WHEN curved >= 0.05 THEN 'mild_curve' ELSE 'prismatic' END"),
    ("von_mises", "xx DOUBLE, yy DOUBLE, zz DOUBLE, yz DOUBLE, xz DOUBLE, xy DOUBLE", "DOUBLE", "sqrt(((xx - yy) * (xx - yy) + (yy - zz) * (yy - zz) + (zz - xx) * (zz - xx)) / 2 + 3 * (yz * yz + xz * xz + xy * xy))"),
    ("tet_volume", "ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by_ DOUBLE, bz DOUBLE, cx DOUBLE, cy DOUBLE, cz DOUBLE, dx DOUBLE, dy DOUBLE, dz DOUBLE", "DOUBLE",
     "((bx - ax) * ((cy - ay) * (dz - az) - (cz - az) * (dy - ay)) + (by_ - ay) * ((cz - az) * (dx - ax) - (cx - ax) * (dz - az)) + (bz - az) * ((cx - ax) * (dy - ay) - (cy - ay) * (dx - ax))) / 6"),
)


class StlTriangles:
    """Table function: (tid, c) of the bytes of an STL file."""

    def eval(self, data: bytes):
        from tessera.sources.meshes import stl_triangles

        for i, c in enumerate(stl_triangles(bytes(data))):
            yield i, c.tolist()


class MshElements:
    """Table function: (eid, etype, tag, nodes by file id) of the bytes of an MSH file."""

    def eval(self, data: bytes):
        from tessera.sources.meshes import parse_msh

        for i, (_, kind, tag, refs) in enumerate(parse_msh(bytes(data))[1]):
            yield i, kind, tag, refs


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in the session; returns their names."""
    from pyspark.sql.functions import udtf

    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("stl_triangles", udtf(StlTriangles, returnType="tid bigint, c array<double>"))
    spark.udtf.register("msh_elements", udtf(MshElements, returnType="eid bigint, etype string, tag int, nodes array<bigint>"))
    return [f[0] for f in FUNCTIONS] + ["stl_triangles", "msh_elements"]
