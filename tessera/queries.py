"""Queries that bind the operators to the benchmark tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import hp, scoring
from .operators import experiments as X
from .operators import fields, ordered, spatial, topology
from .session import saver
from .streaming.run_log import event_sessions, event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, d: str, failure: str = "time_credit") -> DataFrame:
    """Run records: a brand is a configuration, a return flag a part, a line a run."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    line = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_tax", "l_shipdate")
    df = line.join(part, line.l_partkey == part.p_partkey)
    ok, acc, mesh, solve = F.col("l_linestatus") == "O", 1 - F.col("l_discount"), F.col("l_quantity"), F.col("l_tax") * 1000
    return df.select(F.col("p_brand").alias("cfg"), F.col("l_returnflag").alias("part"), ok.alias("ok"), F.when(ok, acc).otherwise(0.0).alias("accuracy"), mesh.alias("mesh_ms"), solve.alias("solve_ms"), scoring.run_score(acc, solve, mesh, ok, failure).alias("score"), "p_type", "p_size", "l_shipdate")


_TIMES = "0.25 * (1 / (1 + l_tax * 1000 / 1000)) + 0.25 * (1 / (1 + l_quantity / 1000))"
_RUNS = f"""runs AS (SELECT p_brand AS cfg, l_returnflag AS part, l_linestatus = 'O' AS ok, CASE WHEN l_linestatus = 'O' THEN 1 - l_discount ELSE 0.0 END AS accuracy,
  l_quantity AS mesh_ms, l_tax * 1000 AS solve_ms, CASE WHEN l_linestatus = 'O' THEN 0.5 * (1 - l_discount) + ({_TIMES}) ELSE {_TIMES} END AS score,
  CASE WHEN l_linestatus = 'O' THEN 0.5 * (1 - l_discount) + ({_TIMES}) ELSE 0.0 END AS strict, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_AGG = """agg AS (SELECT cfg, count(*) AS n_runs, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_fail, round(avg({s}), 6) AS mean_score,
  round(avg(accuracy), 6) AS mean_accuracy, round(avg(mesh_ms), 6) AS mean_mesh_ms, round(avg(solve_ms), 6) AS mean_solve_ms, string_agg(DISTINCT part, ',' ORDER BY part) AS parts FROM runs GROUP BY cfg)"""
_RANK = "SELECT *, CAST(row_number() OVER (ORDER BY mean_score DESC, cfg) AS INTEGER) AS rank FROM agg"


@query(f"WITH {_RUNS}, {_AGG.format(s='score')} {_RANK}")
def config_rank(spark: SparkSession, d: str) -> DataFrame:
    return X.rank(X.aggregate_configs(runs(spark, d)))


@query(f"WITH {_RUNS}, {_AGG.format(s='strict')} {_RANK}")
def config_rank_strict(spark: SparkSession, d: str) -> DataFrame:
    return X.rank(X.aggregate_configs(runs(spark, d, "zero")))


@query(f"""WITH {_RUNS}, per AS (SELECT cfg, p_type, p_size, avg(score) AS m, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM runs GROUP BY ALL),
flat AS (SELECT 'type' AS factor, p_type AS level, m, n, k FROM per UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), m, n, k FROM per)
SELECT factor, level, round(avg(m), 6) AS mean_score, count(*) AS n_configs, CAST(sum(n) AS BIGINT) AS n_runs, round(sum(k) / sum(n), 6) AS ok_rate FROM flat GROUP BY factor, level""")
def factor_breakdown(spark: SparkSession, d: str) -> DataFrame:
    df = runs(spark, d).withColumn("config", F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")))
    return X.factor_breakdown(df)


@query(ORACLE_SQL["factor_breakdown"].replace("SELECT factor, level, round(avg(m)", "SELECT factor, level, mean_score, n_configs, n_runs, ok_rate FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY mean_score DESC, ok_rate DESC, level) AS r FROM (SELECT factor, level, round(avg(m)") + ")) WHERE r = 1")
def best_levels(spark: SparkSession, d: str) -> DataFrame:
    return X.best_levels(factor_breakdown(spark, d))


@query("""WITH t AS (SELECT c_mktsegment, n_name, o_orderpriority, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT 'c_mktsegment' AS condition, c_mktsegment AS value, o_orderpriority AS cfg, round(avg(o_totalprice), 6) AS mean_score, count(*) AS n_runs FROM t GROUP BY ALL
 UNION ALL SELECT 'n_name', n_name, o_orderpriority, round(avg(o_totalprice), 6), count(*) FROM t GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY condition, value ORDER BY mean_score DESC, cfg) AS INTEGER) AS place FROM g) WHERE place <= 5""")
def condition_presets(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    df = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation has 25 rows
    return X.presets(df.select("c_mktsegment", "n_name", F.col("o_orderpriority").alias("cfg"), F.col("o_totalprice").alias("score")), ["c_mktsegment", "n_name"])


_FRONT = "NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice >= p.p_retailprice AND q.p_size <= p.p_size AND (q.p_retailprice > p.p_retailprice OR q.p_size < p.p_size){more})"


@query(f"SELECT p_partkey, p_retailprice, p_size FROM part p WHERE {_FRONT.format(more='')}")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return X.pareto_front(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")


@query(f"SELECT p_brand, p_partkey, p_retailprice, p_size FROM part p WHERE {_FRONT.format(more=' AND q.p_brand = p.p_brand')}")
def pareto_by_part(spark: SparkSession, d: str) -> DataFrame:
    return X.pareto_front(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", ["p_brand"])


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    """All customers as points (sid, x, y, z) of the unit box."""
    hashed = lambda a, m: F.col("c_custkey") * a % m / m
    return table(spark, d, "customer").select(F.col("c_custkey").alias("sid"), ((F.col("c_acctbal") + 1000) / 11000).alias("x"), hashed(7919, 10007).alias("y"), hashed(104729, 20011).alias("z"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_MARK = """WITH s AS (SELECT *, CAST(round(l_extendedprice * 100) AS HUGEINT) AS e FROM lineitem), t AS (SELECT CAST(sum(e * e) AS DOUBLE) AS total FROM s),
w AS (SELECT *, coalesce(CAST(sum(e * e) OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS before FROM s)
SELECT {cols} FROM w, t WHERE {test}"""


@query(_MARK.format(cols=_LINE, test="before < 0.3 * total"))
def dorfler_mark(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(*_LINE.split(", "))
    return ordered.dorfler_mark(df, "l_extendedprice", 0.3, _TIES).filter("marked").drop("marked")


@query(_MARK.format(cols="count(*) AS n, round(sum(l_extendedprice), 2) AS total_eta", test="before >= 0.3 * total"))
def mark_smooth(spark: SparkSession, d: str) -> DataFrame:
    df = ordered.dorfler_mark(table(spark, d, "lineitem").select(*_LINE.split(", ")), "l_extendedprice", 0.3, _TIES)
    return df.filter(~F.col("marked")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total_eta"))


@query("""WITH s AS (SELECT l_suppkey AS cfg, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, cfg) AS rn, count(*) OVER () AS n FROM s) SELECT cfg, score FROM r WHERE rn <= greatest(1, ceil(CAST(0.35 AS DOUBLE) * n))""")
def halving_trim(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cfg")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return X.halving_trim(s, 0.35)


@query("SELECT * FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT DISTINCT p_type AS type FROM part), (SELECT DISTINCT o_orderpriority AS priority FROM orders)")
def grid_expand(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return X.expand_grid({"brand": part.select("p_brand"), "type": part.select("p_type"), "priority": table(spark, d, "orders").select("o_orderpriority")})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return X.remaining(table(spark, d, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("""SELECT cfg, part, tier FROM (SELECT DISTINCT p_brand AS cfg FROM part), (SELECT DISTINCT n_name AS part FROM nation), (SELECT unnest([0, 1, 2]) AS tier)
EXCEPT SELECT p_brand, n_name, 0 FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 45""")
def work_list(spark: SparkSession, d: str) -> DataFrame:
    part, nation, line, supp = (table(spark, d, t) for t in ("part", "nation", "lineitem", "supplier"))
    done = part.join(line.filter("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("s_suppkey") == F.col("l_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    done = done.select(F.col("p_brand").alias("cfg"), F.col("n_name").alias("part"), F.lit(0).alias("tier")).distinct()
    return X.work_list(part.select(F.col("p_brand").alias("cfg")).distinct(), nation.select(F.col("n_name").alias("part")).distinct(), [0, 1, 2], done)


@query("SELECT DISTINCT p_brand AS cfg FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)")
def survivors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("cfg"), "p_size")
    return X.survivors_or_all(p.select("cfg").distinct(), p.filter("p_size > 49"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_ok, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_suspect, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'P')) AS n_fail,
min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS min_rel_err, count(*) FILTER (WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS area_known, count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS area_bad FROM orders""")
def status_counters(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "solve_suspect").otherwise("mesh_fail")
    area = F.when(F.col("o_orderpriority").startswith("1"), True).when(F.col("o_orderpriority").startswith("2"), False)
    return X.status_counters(table(spark, d, "orders").select(status.alias("status"), F.col("o_totalprice").alias("rel_err"), area.alias("area_ok")))


@query("""SELECT p_partkey, 'brand=' || p_brand || ', size=' || p_size || ', type=' || p_type AS label,
CASE WHEN p_size < 5 THEN 'thin_wall' WHEN (p_size - 12) / p_size >= 0.25 THEN 'curved' WHEN (p_size - 12) / p_size >= 0.05 THEN 'mild_curve' ELSE 'prismatic' END AS geom,
round(1 / (1 + p_retailprice / 1000), 6) AS soft_time, round(6 * p_retailprice / power(p_size, 3), 6) AS predicted,
'cfg-' || lpad(lower(to_hex(list_reduce(list_prepend(2216829733::BIGINT, list_transform(string_split(p_brand, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 435) % 4294967296))), 8, '0') AS id FROM part""")
def config_scalars(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    curved = scoring.curved_fraction(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", scoring.config_label(m).alias("label"), scoring.geometry_class(F.col("p_size") < 5, curved).alias("geom"), F.round(scoring.soft_time(F.col("p_retailprice")), 6).alias("soft_time"), F.round(scoring.predicted_elements(F.col("p_retailprice"), F.col("p_size").cast("double")), 6).alias("predicted"), scoring.config_id(F.col("p_brand")).alias("id"))


@query("""WITH f AS (SELECT list_sort(list_distinct([o_custkey, l_partkey, l_suppkey])) AS face FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT face, count(*) AS n FROM f GROUP BY face)
SELECT count(*) FILTER (WHERE n = 1) AS n_boundary, count(*) FILTER (WHERE n = 2) AS n_interior, count(*) FILTER (WHERE n > 2) AS n_nonconforming, count(*) FILTER (WHERE n > 2) = 0 AS conforming FROM c""")
def face_count_classes(spark: SparkSession, d: str) -> DataFrame:
    return topology.conformity(topology.face_classes(_faces(spark, d)))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    df = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return df.select(F.col("l_orderkey").alias("eid"), F.col("l_linenumber").cast("long").alias("local"), F.array("o_custkey", "l_partkey", "l_suppkey").alias("nodes"))


@query("""WITH f AS (SELECT o_custkey AS p, l_partkey AS q, l_suppkey AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT p AS a, q AS b FROM f UNION ALL SELECT q, r FROM f UNION ALL SELECT r, p FROM f), c AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM e GROUP BY ALL)
SELECT a, b, n FROM c WHERE n <> 2""")
def open_edges(spark: SparkSession, d: str) -> DataFrame:
    return topology.open_edges(_faces(spark, d), ["eid"])


@query("""WITH p AS (SELECT o_orderkey AS pos, floor(o_totalprice / 5000) AS q, o_custkey % 7 AS c FROM orders), k AS (SELECT q, c, min(pos) AS first_position, count(*) AS n_points FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY first_position) - 1 AS weld_id FROM k) SELECT pos, weld_id, first_position, n_points FROM p JOIN n ON p.q = n.q AND p.c = n.c""")
def weld_points(spark: SparkSession, d: str) -> DataFrame:
    """Orders as points, welded by price class and customer class; ids in the order of the first position."""
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice") / 5000).alias("q"), (F.col("o_custkey") % 7).alias("c"))
    return topology.weld(p, ["q", "c"], "pos").select("pos", "weld_id", "first_position", "n_points")


@query("""WITH RECURSIVE e AS (SELECT 1000 + s_suppkey AS a, CAST(s_nationkey AS BIGINT) AS b FROM supplier UNION SELECT n_nationkey, 100 + n_regionkey FROM nation), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node) SELECT node, min(seen) AS label FROM r GROUP BY node""")
def connected_regions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, their nations and those nations' regions as one graph."""
    e = table(spark, d, "supplier").select((1000 + F.col("s_suppkey")).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    e = e.union(table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), (100 + F.col("n_regionkey")).cast("long")))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return topology.components(e, nodes, saver(spark, "regions"))


@query("""WITH b(box, lo_n, hi_n, lo_a, hi_a) AS (VALUES ('low', 0, 9, -1e9, 0.0), ('mid', 5, 15, 1000.0, 3000.0), ('all', 20, 24, -1e9, 1e9))
SELECT box, c_custkey FROM customer JOIN b ON c_nationkey BETWEEN lo_n AND hi_n AND c_acctbal BETWEEN lo_a AND hi_a""")
def box_select(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.sql("SELECT * FROM VALUES ('low', 0D, 9D, -1e9D, 0D), ('mid', 5D, 15D, 1000D, 3000D), ('all', 20D, 24D, -1e9D, 1e9D) AS b(box, lo_n, hi_n, lo_a, hi_a)")
    pts = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("n"), F.col("c_acctbal").alias("a"))
    return spatial.box_select(pts, boxes, ["n", "a"]).select("box", "c_custkey")


_XYZ = "(SELECT c_custkey AS id, c_acctbal / 10 AS x, c_nationkey * 10.0 AS y, (c_custkey % 50) * 1.0 AS z FROM customer) c, (SELECT s_suppkey AS id, s_acctbal / 10 AS x, s_nationkey * 10.0 AS y, (s_suppkey % 50) * 1.0 AS z FROM supplier) s"
_D2 = "(c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) + (c.z - s.z) * (c.z - s.z)"


def _points(spark: SparkSession, d: str, name: str, key: str, as_key: str) -> DataFrame:
    p = name[0]
    return table(spark, d, name).select(F.col(key).alias(as_key), (F.col(f"{p}_acctbal") / 10).alias("x"), (F.col(f"{p}_nationkey") * 10.0).alias("y"), ((F.col(key) % 50) * 1.0).alias("z"))


@query(f"SELECT c.id AS pid, s.id AS sid, round({_D2}, 6) AS d2 FROM {_XYZ} WHERE {_D2} <= 900")
def within_ball(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.within(_points(spark, d, "customer", "c_custkey", "pid"), _points(spark, d, "supplier", "s_suppkey", "sid"), 30.0)
    return out.withColumn("d2", F.round("d2", 6))


@query(f"SELECT DISTINCT c.id AS pid FROM {_XYZ} WHERE {_D2} <= 900")
def near_any(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_any(_points(spark, d, "customer", "c_custkey", "pid"), _points(spark, d, "supplier", "s_suppkey", "sid"), 30.0).select("pid")


@query(f"SELECT pid, m.sid AS sid, round(m.d2, 6) AS d2 FROM (SELECT c.id AS pid, min({{'d2': {_D2}, 'sid': s.id}}) AS m FROM {_XYZ} GROUP BY c.id)")
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest(_points(spark, d, "customer", "c_custkey", "pid"), _points(spark, d, "supplier", "s_suppkey", "sid"), 40.0, saver(spark, "nearest"))
    return out.withColumn("d2", F.round("d2", 6))


@query("""SELECT s_suppkey AS pid, m.sid AS sid, round(m.dist, 6) AS dist FROM (SELECT s_suppkey, min({'dist': abs(s_acctbal - c_acctbal), 'sid': c_custkey}) AS m FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY 1)""")
def nearest_in_nation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return spatial.nearest_1d(s, c, ["k"]).withColumn("dist", F.round("dist", 6))


@query("""SELECT p_partkey AS pid, round(greatest(1.0, least(20.0, coalesce(min(h + 0.5 * abs(p_retailprice - sx)), 20.0))), 6) AS size FROM (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part)
LEFT JOIN (SELECT s_acctbal / 5 AS sx, 1.0 + s_suppkey % 4 AS h FROM supplier) ON true GROUP BY p_partkey""")
def size_field_min_plus(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_retailprice").alias("x"))
    s = table(spark, d, "supplier").select((F.col("s_acctbal") / 5).alias("x"), (1.0 + F.col("s_suppkey") % 4).alias("h"))
    return spatial.min_plus(p, s, 0.5, 1.0, 20.0, ["x"]).select("pid", F.round("size", 6).alias("size"))


@query("SELECT p_partkey, p_size, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY floor(p_size / 5), p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def finest_per_cell(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return spatial.finest_per_cell(p, [F.floor(F.col("p_size") / 5), F.col("p_brand")], "p_retailprice", "p_partkey").drop("p_brand")


@query("""SELECT s_suppkey AS nid, coalesce(round(avg(o_totalprice), 4), 0.0) AS sigma FROM supplier LEFT JOIN (SELECT l_suppkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def nodal_average(spark: SparkSession, d: str) -> DataFrame:
    """Orders as elements, their lines' suppliers as nodes."""
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("eid"), F.col("l_suppkey").alias("nid"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("eid"), F.col("o_totalprice").alias("sigma"))
    out = fields.nodal_average(inc, own, ["sigma"], table(spark, d, "supplier").select(F.col("s_suppkey").alias("nid")))
    return out.withColumn("sigma", F.round("sigma", 4))


@query("""WITH k AS (SELECT l_suppkey AS row, l_partkey AS col, sum(CAST(l_quantity AS DECIMAL(18,2))) AS val FROM lineitem GROUP BY ALL)
SELECT row AS i, CAST(sum(val * p_size) AS DOUBLE) AS val FROM k JOIN part ON col = p_partkey GROUP BY row""")
def coo_spmv(spark: SparkSession, d: str) -> DataFrame:
    k = fields.assemble(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("decimal(18,2)").alias("val")))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("val"))
    return fields.spmv(k, x).withColumn("val", F.col("val").cast("double"))


@query("""SELECT l_partkey, n, CASE WHEN n >= 4 AND b IS NOT NULL THEN round(a + b * 25, 4) ELSE round(m, 4) END AS value FROM
(SELECT l_partkey, count(*) AS n, avg(l_extendedprice) AS m, CASE WHEN var_pop(l_quantity) > 0 THEN regr_slope(l_extendedprice, l_quantity) END AS b, CASE WHEN var_pop(l_quantity) > 0 THEN regr_intercept(l_extendedprice, l_quantity) END AS a FROM lineitem GROUP BY 1)""")
def patch_lsq(spark: SparkSession, d: str) -> DataFrame:
    out = fields.patch_line(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice", 25.0, 4)
    return out.withColumn("value", F.round("value", 4))


@query("SELECT event_type, v[CAST(1 + floor(0.99 * (len(v) - 1)) AS BIGINT)] AS quantile, len(v) AS n FROM (SELECT event_type, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) AS v FROM events GROUP BY 1)")
def exact_p99(spark: SparkSession, d: str) -> DataFrame:
    return ordered.lower_rank_quantile(table(spark, d, "events"), ["event_type"], "value", 0.99)


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) OVER o AS acc, row_number() OVER o AS rn, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total, 0.6 * sum(l_quantity) OVER (PARTITION BY l_orderkey) AS target FROM lineitem
WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)), m AS (SELECT l_orderkey AS k, min({'e': abs(acc - target), 'rn': rn}).rn AS cut FROM w GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM w JOIN m ON k = l_orderkey WHERE total <= 1.05 * target OR rn <= cut""")
def running_area_cut(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    whole = df.groupBy("l_orderkey").agg((0.6 * F.sum("l_quantity")).alias("target"))
    kept = ordered.cut_nearest(df.join(whole, "l_orderkey"), ["l_orderkey"], "l_quantity", ["l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", F.col("target"))
    return kept.drop("l_extendedprice", "target")


@query("""WITH a AS (SELECT user_id, event_id % 360 AS angle FROM events), g AS (SELECT user_id, angle, lead(angle) OVER (PARTITION BY user_id ORDER BY angle) - angle AS gap FROM a)
SELECT user_id, count(*) AS n, CAST(greatest(coalesce(max(gap), 0), min(angle) + 360 - max(angle)) AS DOUBLE) AS max_gap FROM g GROUP BY user_id""")
def azimuth_gap(spark: SparkSession, d: str) -> DataFrame:
    return ordered.largest_gap(table(spark, d, "events").select("user_id", (F.col("event_id") % 360).cast("double").alias("angle")), ["user_id"], "angle", 360.0)


@query("""WITH c AS (SELECT DISTINCT user_id, round(value, 1) AS v FROM events) SELECT c_custkey, count(v) AS n_below, count(v) % 2 = 1 AS inside FROM customer LEFT JOIN c ON user_id = c_custkey AND v <= c_acctbal / 100 GROUP BY c_custkey""")
def parity(spark: SparkSession, d: str) -> DataFrame:
    cross = table(spark, d, "events").select(F.col("user_id").alias("k"), F.round("value", 1).alias("at"))
    pts = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 100).alias("z"))
    return ordered.parity_inside(cross, pts, "k", "at", "z").select("c_custkey", F.col("n_below").cast("long").alias("n_below"), "inside")


@query("""WITH v AS (SELECT l_suppkey, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, max(n) AS most, CAST(sum(n) AS BIGINT) AS voices FROM v GROUP BY 1)
SELECT v.l_suppkey, any_value(voices) AS voices, CASE WHEN count(*) = 1 THEN any_value(f) ELSE 'keep' END AS winner FROM v JOIN m ON v.l_suppkey = m.l_suppkey AND n = most GROUP BY v.l_suppkey""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return fields.majority(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("""WITH s AS (SELECT p_partkey, CAST(0.1 + (p_size % 5) / 10 AS DOUBLE) AS h, CAST(p_size / 50 AS DOUBLE) AS kappa, CASE WHEN p_size % 7 > 0 THEN CAST(1.0 + p_size AS DOUBLE) END AS thickness, CAST(p_retailprice / 2000 AS DOUBLE) AS eta,
 CAST((p_size % 10) / 20 AS DOUBLE) AS surplus, CAST(1 + p_size % 4 AS INTEGER) AS p, CAST((p_partkey % 10) / 10 AS DOUBLE) AS hx, CAST((p_partkey % 7) / 7 AS DOUBLE) AS tt, CAST((p_partkey % 3) / 3 AS DOUBLE) AS po FROM part),
m AS (SELECT max(eta) AS top FROM s),
t AS (SELECT *, greatest(0::DOUBLE, h * kappa / (15 * pi() / 180), coalesce(h / (0.35 * thickness), 0)) AS sev, surplus / greatest(eta, 1e-30) AS ratio, greatest(0::DOUBLE, least(1::DOUBLE, surplus / greatest(eta, 1e-30) / 0.45)) AS smooth,
 list_sort([hx, tt, po]) AS fits, greatest(top, 1e-6) AS floor, greatest(hx, tt, po) - least(hx, tt, po) AS spread FROM s, m),
g AS (SELECT *, CASE WHEN fits[3] - fits[2] < 0.08 THEN 'keep' WHEN fits[3] = hx THEN 'hex' WHEN fits[3] = tt THEN 'tet' ELSE 'poly' END AS vote, CASE WHEN hx < 0.4 AND kappa > 0 AND h * kappa > 0.05 THEN greatest(spread, 0.35::DOUBLE) ELSE spread END AS awkward FROM t),
u AS (SELECT *, eta < 1e-4 * top AS idle, CASE WHEN sev >= 1 THEN sev * greatest(eta, 0.1 * floor) ELSE eta * (1 - smooth) * (1 - smooth) END / 8 AS uh,
 CASE WHEN sev < 1 AND p < 3 AND ratio >= 0.225 THEN eta * smooth * smooth * (1 - 0.15 * p) ELSE 0 END / (2.5 + 0.4 * p) AS up, CASE WHEN vote = 'keep' THEN 0 ELSE awkward * greatest(eta, 0.05 * floor) * CASE WHEN sev >= 1 THEN 0.25 ELSE 1 END END / 3.5 AS us FROM g)
SELECT p_partkey, CASE WHEN idle OR greatest(uh, up, us) < 1e-12 THEN 'none' WHEN uh >= up AND uh >= us THEN 'h' WHEN up >= us THEN 'p' ELSE 'shape' END AS action,
round(CASE WHEN idle THEN 0 ELSE uh END::DOUBLE, 9) AS utility_h, round(CASE WHEN idle THEN 0 ELSE up END::DOUBLE, 9) AS utility_p, round(CASE WHEN idle THEN 0 ELSE us END::DOUBLE, 9) AS utility_shape FROM u""")
def hp_decide(spark: SparkSession, d: str) -> DataFrame:
    c, size, key = F.col, F.col("p_size"), F.col("p_partkey")
    part = table(spark, d, "part")
    top = part.agg((F.max("p_retailprice") / 2000).alias("top"))
    x = hp.decide(0.1 + (size % 5) / 10, size / 50, F.when(size % 7 > 0, 1.0 + size), c("p_retailprice") / 2000, (size % 10) / 20, 1 + size % 4, F.lit(3), (key % 10) / 10, (key % 7) / 7, (key % 3) / 3, c("top"))
    return part.crossJoin(F.broadcast(top)).select("p_partkey", x["action"].alias("action"), *[F.round(x[k], 9).alias(k) for k in ("utility_h", "utility_p", "utility_shape")])  # top is one row


_TET = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(sqrt(((x - y) * (x - y) + (y - z) * (y - z) + (z - x) * (z - x)) / 2 + 3 * (x * x + y * y + z * z)), 6) AS von_mises, round(x * y * z / 6, 6) AS volume,
CASE WHEN x * y * z <= 0 THEN 0.0 ELSE round(least(1.0, 6 * sqrt(2.0) * (x * y * z / 6) / power(greatest(x, y, z, sqrt(x * x + y * y), sqrt(x * x + z * z), sqrt(y * y + z * z)), 3)), 6) END AS aspect FROM ({_TET})""")
def tet_scalars(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    x, y, z, o = F.col("x"), F.col("y"), F.col("z"), F.lit(0.0)
    t = ((o, o, o), (x, o, o), (o, y, o), (o, o, z))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(G.von_mises(x, y, z, x, y, z), 6).alias("von_mises"), F.round(G.tet_volume(*t), 6).alias("volume"), F.round(G.tet_aspect(*t), 6).alias("aspect"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def event_windows_hourly(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions_users(spark: SparkSession, d: str) -> DataFrame:
    return event_sessions(table(spark, d, "events"))


@query("""SELECT o_custkey, count(*) AS n, string_agg(CAST(o_totalprice AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS series, arg_min(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS first, arg_max(o_totalprice, {'d': o_orderdate, 'k': o_orderkey}) AS last FROM orders GROUP BY 1""")
def trend_series(spark: SparkSession, d: str) -> DataFrame:
    out = X.trend(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.withColumn("n", F.col("n").cast("long"))


@query("""SELECT s_nationkey AS g, ratio FROM (SELECT s_nationkey, s_suppkey, max(CAST(c_custkey AS DOUBLE) / s_suppkey) AS ratio FROM supplier JOIN customer ON s_acctbal >= c_acctbal * (1 - 1e-4) AND s_suppkey < c_custkey WHERE s_suppkey > 0 GROUP BY ALL ORDER BY ratio DESC, s_suppkey LIMIT 1)""")
def graded_uniform_pair(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("energy"), F.col("s_suppkey").alias("dof"), "s_nationkey")
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("energy"), F.col("c_custkey").alias("dof"))
    best = X.graded_pairs(g, u)
    return best.join(g.select(F.col("id").alias("g"), "s_nationkey"), "g").select(F.col("s_nationkey").alias("g"), "ratio")


@query("SELECT true AS orphan, p_partkey AS nid FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem)")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("nid"))
    elements = table(spark, d, "lineitem").select(F.array("l_suppkey").alias("nodes"))
    return topology.orphans(nodes, elements).select(F.lit(True).alias("orphan"), "nid")


@query("""SELECT l_partkey AS entity, CAST(min(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS INTEGER) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def entity_minimum(spark: SparkSession, d: str) -> DataFrame:
    inc = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("eid"), F.col("l_partkey").alias("entity"))
    return fields.entity_minimum(inc, table(spark, d, "orders").select(F.col("o_orderkey").alias("eid"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p")))


@query("SELECT p_type AS etype, count(*) AS n FROM part GROUP BY 1")
def element_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return topology.element_type_counts(table(spark, d, "part").withColumnRenamed("p_type", "etype"))


@query("""WITH t(a, b, c, d) AS (VALUES (0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7)), g AS (SELECT DISTINCT CAST(least(9, floor((c_acctbal + 1000) / 1100)) AS BIGINT) AS i, CAST(c_nationkey * 10 // 25 AS BIGINT) AS j, CAST(c_custkey % 10 AS BIGINT) AS k FROM customer),
e AS (SELECT row_number() OVER () AS eid, i, j, k, [a, b, c, d] AS own FROM g, t), v AS (SELECT eid, list_transform(own, lambda n: [i + n % 2, j + (n // 2) % 2, k + n // 4]) AS p FROM e),
f AS (SELECT list_sort([p[1], p[2], p[3]]) AS face FROM v UNION ALL SELECT list_sort([p[1], p[2], p[4]]) FROM v UNION ALL SELECT list_sort([p[1], p[3], p[4]]) FROM v UNION ALL SELECT list_sort([p[2], p[3], p[4]]) FROM v),
n AS (SELECT face, count(*) AS n FROM f GROUP BY face), w AS (SELECT unnest(p) AS node FROM v),
s AS (SELECT face, list_transform(face[1], lambda x, q: (x + face[2][q] + face[3][q]) / 3) AS m FROM n WHERE n = 1),
d AS (SELECT [p[2][1] - p[1][1], p[2][2] - p[1][2], p[2][3] - p[1][3]] AS u, [p[3][1] - p[1][1], p[3][2] - p[1][2], p[3][3] - p[1][3]] AS q, [p[4][1] - p[1][1], p[4][2] - p[1][2], p[4][3] - p[1][3]] AS r FROM v)
SELECT CAST((SELECT count(*) FROM g) AS INTEGER) AS n_cells, CAST((SELECT count(DISTINCT node) FROM w) AS INTEGER) AS n_nodes, CAST((SELECT count(*) FROM v) AS INTEGER) AS n_elements,
 CAST((SELECT count(*) FROM n WHERE n = 1) AS INTEGER) AS n_boundary, CAST((SELECT count(*) FROM n WHERE n = 2) AS INTEGER) AS n_interior,
 CAST((SELECT count(*) FROM s WHERE least(m[1], 10 - m[1], m[2], 10 - m[2], m[3], 10 - m[3]) > 0.000001) AS INTEGER) AS n_hanging,
 round((SELECT CAST(sum(u[1] * (q[2] * r[3] - q[3] * r[2]) + u[2] * (q[3] * r[1] - q[1] * r[3]) + u[3] * (q[1] * r[2] - q[2] * r[1])) AS DOUBLE) / 6000 FROM d), 9) AS volume""")
def lattice_tet_box(spark: SparkSession, d: str) -> DataFrame:
    """The cells of a 10 x 10 x 10 lattice that hold customers: Kuhn tetrahedra, skin, conformity, faces off the box's sides, volume."""
    from .plans import lattice

    counts, h, save = (10, 10, 10), 0.1, saver(spark, "lattice")
    at = {"i": F.least(F.lit(9), F.floor((F.col("c_acctbal") + 1000) / 1100)), "j": F.floor(F.col("c_nationkey") * 10 / 25), "k": F.col("c_custkey") % 10}
    c = save(table(spark, d, "customer").select(*[v.cast("long").alias(n) for n, v in at.items()]).distinct().selectExpr("(k * 10 + j) * 10 + i AS cell", "*"))
    e, nodes = save(lattice.fill(c, counts)), lattice.lattice_nodes(spark, counts, h)
    used = topology.incidence(e).select("nid").distinct()
    f = topology.faces(e)
    both = topology.conformity(topology.face_classes(f))
    hanging = topology.hanging_faces(topology.boundary_skin(f), nodes, 1e-9).agg(F.count("*").cast("int").alias("n_hanging"))
    flat = e
    for i in range(4):
        flat = flat.withColumn("nid", F.element_at("nodes", i + 1)).join(nodes.toDF("nid", f"p{i}x", f"p{i}y", f"p{i}z"), "nid").drop("nid")
    volume = flat.agg(F.count("*").cast("int").alias("n_elements"), F.round(F.sum(G.tet_volume(*[G.vec(f"p{i}") for i in range(4)])), 9).alias("volume"))
    sizes = c.agg(F.count("*").cast("int").alias("n_cells")).crossJoin(used.agg(F.count("*").cast("int").alias("n_nodes")))
    return both.select(F.col("n_boundary").cast("int").alias("n_boundary"), F.col("n_interior").cast("int").alias("n_interior")).crossJoin(hanging).crossJoin(volume).crossJoin(sizes)  # single rows


def _octree_sql(depth: int) -> str:
    """The balanced octree level by level, and what its leaves become, by looking at each neighbour."""
    closed = ", ".join(
        f"n{l} AS (SELECT i, j, k FROM own WHERE level = {l}" + (f" UNION SELECT (i + a) >> 1, (j + b) >> 1, (k + c) >> 1 FROM n{l + 1}, (SELECT x.x - 1 AS a, y.x - 1 AS b, z.x - 1 AS c FROM range(3) x(x), range(3) y(x), range(3) z(x)) WHERE least(i + a, j + b, k + c) >= 0 AND greatest(i + a, j + b, k + c) < {4 << l + 1}" if l + 1 < depth else "") + ")"
        for l in range(depth - 1, -1, -1)
    )
    leaves = " UNION ALL ".join([f"SELECT {l + 1} AS level, 2 * i + x.x AS i, 2 * j + y.x AS j, 2 * k + z.x AS k FROM n{l}, range(2) x(x), range(2) y(x), range(2) z(x)" for l in range(depth)] + ["SELECT 0, x.x, y.x, z.x FROM range(4) x(x), range(4) y(x), range(4) z(x)"])
    return f"""WITH p AS (SELECT (c_acctbal + 1000) / 11000 * 4 AS x, c_nationkey / 25 * 4 AS y, c_custkey % 40 / 10 AS z, CASE WHEN c_mktsegment = 'BUILDING' THEN {depth} ELSE 2 END AS want FROM customer),
own AS (SELECT DISTINCT level, CAST(floor(x * pow(2, level)) AS BIGINT) AS i, CAST(floor(y * pow(2, level)) AS BIGINT) AS j, CAST(floor(z * pow(2, level)) AS BIGINT) AS k FROM p, range({depth}) r(level) WHERE level < want AND x < 4), {closed},
split AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {l} AS level, * FROM n{l}" for l in range(depth))}), cell AS MATERIALIZED (SELECT * FROM ({leaves}) c ANTI JOIN split s ON s.level = c.level AND s.i = c.i AND s.j = c.j AND s.k = c.k),
step AS (SELECT x.x - 1 AS a, y.x - 1 AS b, z.x - 1 AS c FROM range(3) x(x), range(3) y(x), range(3) z(x) WHERE abs(x.x - 1) + abs(y.x - 1) + abs(z.x - 1) IN (1, 2)),
near AS MATERIALIZED (SELECT c.*, a, b, step.c FROM cell c, step JOIN split s ON s.level = c.level AND s.i = c.i + a AND s.j = c.j + b AND s.k = c.k + step.c),
face AS (SELECT c.*, f.a AS fa, f.b AS fb, f.c AS fc FROM (SELECT DISTINCT level, i, j, k FROM near) c, step f WHERE abs(f.a) + abs(f.b) + abs(f.c) = 1),
side AS (SELECT f.*, g.a, g.b, g.c FROM face f, step g WHERE abs(g.a) + abs(g.b) + abs(g.c) = 1 AND fa * g.a + fb * g.b + fc * g.c = 0),
hung AS (SELECT s.level, s.i, s.j, s.k, fa, fb, fc, s.a, s.b, s.c FROM side s SEMI JOIN near n ON n.level = s.level AND n.i = s.i AND n.j = s.j AND n.k = s.k AND ((n.a = s.a AND n.b = s.b AND n.c = s.c) OR (n.a = fa + s.a AND n.b = fb + s.b AND n.c = fc + s.c))),
cut AS (SELECT f.level, f.i, f.j, f.k, n.a IS NOT NULL AS quarters, coalesce(h.n, 0) AS hung FROM face f LEFT JOIN near n ON n.level = f.level AND n.i = f.i AND n.j = f.j AND n.k = f.k AND n.a = fa AND n.b = fb AND n.c = fc
        LEFT JOIN (SELECT level, i, j, k, fa, fb, fc, count(*) AS n FROM hung GROUP BY ALL) h ON h.level = f.level AND h.i = f.i AND h.j = f.j AND h.k = f.k AND h.fa = f.fa AND h.fb = f.fb AND h.fc = f.fc),
n AS (SELECT level, i, j, k, sum(CASE WHEN quarters THEN 4 WHEN hung > 0 THEN 0 ELSE 1 END) AS pyramids, sum(CASE WHEN quarters OR hung = 0 THEN 0 ELSE 4 + hung END) AS tets FROM cut GROUP BY ALL)
SELECT c.level, c.i, c.j, c.k, CAST(CASE WHEN n.level IS NULL THEN 1 ELSE 0 END AS BIGINT) AS hexes, CAST(coalesce(pyramids, 0) AS BIGINT) AS pyramids, CAST(coalesce(tets, 0) AS BIGINT) AS tets FROM cell c LEFT JOIN n ON n.level = c.level AND n.i = c.i AND n.j = c.j AND n.k = c.k"""


@query(_octree_sql(4))
def octree_fill(spark: SparkSession, d: str) -> DataFrame:
    """A balanced octree finest around some customers, and the elements that each leaf becomes."""
    from .plans import octree

    counts, depth, save = (4, 4, 4), 4, saver(spark, "octree")
    xyz = {"x": (F.col("c_acctbal") + 1000) / 11000 * 4, "y": F.col("c_nationkey") / 25 * 4, "z": F.col("c_custkey") % 40 / 10}
    points = table(spark, d, "customer").select(*[v.alias(c) for c, v in xyz.items()], F.when(F.col("c_mktsegment") == "BUILDING", depth).otherwise(2).alias("level"))
    inner = save(octree.balance(octree.wanted(points, 1.0, counts), counts, depth, save))
    marked = save(octree.transitions(octree.leaves(spark, inner, counts, depth), inner))
    made = octree.elements(marked, counts, depth).groupBy(F.shiftright("eid", 7).alias("code"))
    kinds = made.agg(*[F.count_if(F.col("etype") == e).alias(n) for e, n in (("hex8", "hexes"), ("pyramid5", "pyramids"), ("tet4", "tets"))])
    return marked.join(kinds, "code").select("level", "i", "j", "k", "hexes", "pyramids", "tets")


_CLOUD = "SELECT c_custkey AS sid, (c_acctbal + 1000) / 11000 AS x, (c_custkey * 7919 % 10007) / 10007 AS y, (c_custkey * 104729 % 20011) / 20011 AS z FROM customer"


@query(f"""WITH p AS ({_CLOUD}), n AS (SELECT a.sid, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS gap FROM p a JOIN p b ON a.sid <> b.sid GROUP BY 1)
SELECT sid, round(gap, 9) AS gap, 1.0 AS all_cells, 6.0 AS all_sides, true AS mutual FROM n""")
def voronoi_cells(spark: SparkSession, d: str) -> DataFrame:
    """Clipped Voronoi cells of all customers: the nearest neighbour across each cell's faces, that the cells fill the box and its sides, and that neighbours are mutual."""
    from .operators.voronoi import voronoi_cells as cells

    save = saver(spark, "voronoi")
    hashed = lambda a, m: F.col("c_custkey") * a % m / m
    p = save(table(spark, d, "customer").select(F.col("c_custkey").alias("sid"), ((F.col("c_acctbal") + 1000) / 11000).alias("x"), hashed(7919, 10007).alias("y"), hashed(104729, 20011).alias("z")))
    size = 3.2 * max(1, p.count()) ** (-1 / 3)
    found = cells(p, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), size, save)  # written already
    sides = save(found.select("sid", F.explode("faces").alias("f")).select("sid", F.col("f.owner").alias("other"), G.polygon_area("f.points").alias("area")))
    at = p.toDF("other", "ox", "oy", "oz")
    near = sides.filter("other >= 0").hint("merge").join(p, "sid").hint("merge").join(at, "other").groupBy("sid").agg(F.round(F.min(G.norm(G.sub(G.vec(""), G.vec("o")))), 9).alias("gap"))
    back = sides.filter("other >= 0").select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"), F.when(F.col("sid") < F.col("other"), F.col("area")).otherwise(-F.col("area")).alias("area"))
    mutual = back.groupBy("a", "b").agg(F.sum("area").alias("d")).agg(F.coalesce(F.max(F.abs("d")) < 1e-9, F.lit(True)).alias("mutual"))
    whole = found.agg(F.round(F.sum("volume"), 6).alias("all_cells")).crossJoin(sides.filter("other < 0").agg(F.round(F.sum("area"), 6).alias("all_sides"))).crossJoin(mutual)
    return near.crossJoin(F.broadcast(whole))  # one row


@query("SELECT count(*) AS n_sites, 0 AS n_conflicts, 0 AS n_addable FROM customer")
def protecting_balls(spark: SparkSession, d: str) -> DataFrame:
    """Independent balls among all customers: pairs chosen though too near, and sites left out though free (none of either)."""
    from .plans.protect import APART, independent_balls

    save = saver(spark, "balls")
    hashed = lambda a, m: F.col("c_custkey") * a % m / m
    r = 0.02 * F.pow(F.lit(2.0), -(F.col("c_nationkey") % 4))
    p = save(table(spark, d, "customer").select(F.col("c_custkey").alias("sid"), ((F.col("c_acctbal") + 1000) / 11000).alias("x"), hashed(7919, 10007).alias("y"), hashed(104729, 20011).alias("z"), r.alias("r")))
    chosen = save(independent_balls(p, save))
    pairs = spatial.within(p.withColumnsRenamed({"sid": "pid", "r": "r1"}), chosen.withColumnRenamed("r", "r2"), 0.02 * APART, ("r1",), ("r2",))
    held = save(pairs.filter((F.col("pid") == F.col("sid")) | (F.sqrt("d2") < APART * F.greatest("r1", "r2"))).select("pid", "sid"))
    both = held.filter("pid <> sid").hint("merge").join(chosen.select(F.col("sid").alias("pid")), "pid", "left_semi").agg(F.count("*").cast("int").alias("n_conflicts"))
    free = p.hint("merge").join(held.select(F.col("pid").alias("sid")), "sid", "left_anti").agg(F.count("*").cast("int").alias("n_addable"))
    return p.agg(F.count("*").alias("n_sites")).crossJoin(both).crossJoin(free)  # single rows


@query("""SELECT count(*) AS n, min(l_quantity * l_tax) AS min_volume, max(l_quantity * l_tax) AS max_volume, min(l_discount) AS min_aspect, round(avg(l_discount), 6) AS mean_aspect, count(*) FILTER (WHERE l_discount < 0.05) AS n_slivers FROM lineitem""")
def tet_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select((F.col("l_quantity") * F.col("l_tax")).alias("volume"), F.col("l_discount").alias("aspect"))
    return fields.tet_quality(df)


@query("SELECT min(c_acctbal / 10) AS min_x, max(c_acctbal / 10) AS max_x, min(c_nationkey * 10.0::DOUBLE) AS min_y, max(c_nationkey * 10.0::DOUBLE) AS max_y, min((c_custkey % 50) * 1.0::DOUBLE) AS min_z, max((c_custkey % 50) * 1.0::DOUBLE) AS max_z FROM customer")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return spatial.bounding_box(_points(spark, d, "customer", "c_custkey", "pid"))


@query("SELECT CAST(least(floor(l_quantity / 51 * 48), 47) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, bin LIMIT 1")
def radius_peak(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_peak(table(spark, d, "lineitem"), F.col("l_quantity"), 48, 51.0)


@query("""SELECT p_partkey, round((CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size * 0.5 END + p_retailprice * 0.3 + CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey * 0.2 END) / (CASE WHEN p_size % 3 = 0 THEN 0 ELSE 0.5 END + 0.3 + CASE WHEN p_size % 5 = 0 THEN 0 ELSE 0.2 END), 4) AS score FROM part""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("a"), F.col("p_retailprice").alias("b"), F.when(F.col("p_size") % 5 != 0, F.col("p_partkey")).alias("c"))
    return fields.weighted_scorecard(df, {"a": 0.5, "b": 0.3, "c": 0.2}).select("p_partkey", F.round("score", 4).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN l_tax = 0 THEN abs(l_discount) ELSE abs(l_discount - l_tax) / abs(l_tax) END, 6) AS rel_err,
round(CASE WHEN l_linestatus = 'O' THEN 1 / (1 + (CASE WHEN l_tax = 0 THEN abs(l_discount) ELSE abs(l_discount - l_tax) / abs(l_tax) END) / 0.05) ELSE 0.0 END, 6) AS score FROM lineitem""")
def metric_scores(spark: SparkSession, d: str) -> DataFrame:
    rel = scoring.relative_error(F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(rel, 6).alias("rel_err"), F.round(scoring.metric_score(rel, F.lit(None).cast("double"), F.col("l_linestatus") == "O"), 6).alias("score"))


@query("""WITH e AS (SELECT l_orderkey AS eid, l_partkey AS a, l_suppkey AS b FROM lineitem), r AS (SELECT p_partkey AS nid, p_size % 3 AS region FROM part)
SELECT DISTINCT eid AS mid, CAST(r1.region AS INTEGER) AS region FROM e JOIN r r1 ON r1.nid = a JOIN r r2 ON r2.nid = b WHERE r1.region = r2.region""")
def midpoint_regions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mid"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    r = table(spark, d, "part").select(F.col("p_partkey").alias("nid"), (F.col("p_size") % 3).alias("region"))
    return spatial.regions_of_midpoints(e, r).distinct()


_PASS = _XYZ.replace("FROM supplier)", "FROM supplier WHERE s_suppkey % 3 > 0)")


@query(f"SELECT round(sum(area * v) / sum(area), 6) AS mean, count(*) AS n FROM (SELECT c.id AS pid, 1 + c.id % 4 AS area, min({{'d2': {_D2}, 'sid': s.id}}).sid % 11 AS v FROM {_PASS} GROUP BY c.id)")
def nearest_passing_mean(spark: SparkSession, d: str) -> DataFrame:
    f = _points(spark, d, "customer", "c_custkey", "pid").withColumn("area", 1 + F.col("pid") % 4)
    e = _points(spark, d, "supplier", "s_suppkey", "sid").withColumn("quality", (F.col("sid") % 3).cast("double")).withColumn("v", F.col("sid") % 11)
    out = spatial.weighted_value(f, spatial.nearest_passing(f, e, 1.0, 60.0, saver(spark, "passing")), e, "v")
    return out.select(F.round("mean", 6).alias("mean"), "n")


@query(f"SELECT round(avg(sqrt(d2)), 6) AS mean_gap, count(*) AS n FROM (SELECT c.id, min({_D2}) AS d2 FROM {_XYZ.replace('c_acctbal', 's_acctbal').replace('c_nationkey', 's_nationkey').replace('c_custkey', 's_suppkey').replace('FROM customer', 'FROM supplier')} WHERE c.id <> s.id GROUP BY c.id)")
def nearest_other_gap(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest_other_gap(_points(spark, d, "supplier", "s_suppkey", "sid"), 50.0, saver(spark, "gap"))
    return out.select(F.round("mean_gap", 6).alias("mean_gap"), "n")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * l_partkey + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h(node, hops) USING KEY (node) AS (SELECT min(a), 0 FROM e UNION SELECT DISTINCT l.b, h.hops + 1 FROM h JOIN l ON l.a = h.node WHERE l.b NOT IN (SELECT node FROM recurring.h)) SELECT node, hops FROM h""")
def hop_distance(spark: SparkSession, d: str) -> DataFrame:
    """Hops over the whole customer-part graph from its least customer, to exhaustion: customers are even nodes, parts odd ones."""
    save = saver(spark, "hops")
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = save(line.join(orders, line.l_orderkey == orders.o_orderkey).select((2 * F.col("o_custkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")).distinct())
    return topology.hops(e, e.agg(F.min("a").alias("node")).filter("node is not null"), save)


@query("""WITH n AS (SELECT vec_id, embedding AS e FROM embeddings) SELECT a.vec_id, arg_min(b.vec_id, {'d': round(1 - list_cosine_similarity(a.e, b.e), 5), 'i': b.vec_id}) AS nearest FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1""")
def embedding_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vector of any label among all rows, for the stated queries (ids divisible by 20)."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return spatial.nearest_vectors(e.filter("vec_id % 20 = 0"), e)


@query("""WITH t AS (SELECT o_orderkey AS eid, o_custkey AS p, 1000000 + o_orderkey % 97 AS q FROM orders), u AS (SELECT p AS nid FROM t UNION SELECT q FROM t), k AS (SELECT nid, row_number() OVER (ORDER BY nid) - 1 AS new FROM u)
SELECT eid, a.new AS p, b.new AS q, a.nid AS was_p FROM t JOIN k a ON a.nid = t.p JOIN k b ON b.nid = t.q""")
def compact_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as elements over their customer and a class node; unused nodes go, the rest is renumbered."""
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("eid"), F.array(F.col("o_custkey"), 1000000 + F.col("o_orderkey") % 97).alias("nodes"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("nid")).union(spark.range(1000000, 1000200).toDF("nid")).withColumn("was", F.col("nid"))
    kept, new = topology.compact(nodes, e)
    out = new.select("eid", F.col("nodes")[0].alias("p"), F.col("nodes")[1].alias("q"))
    return out.join(kept.select(F.col("nid").alias("p"), F.col("was").alias("was_p")), "p")


@query(ORACLE_SQL["factor_breakdown"].replace("SELECT factor, level, round(avg(m)", "SELECT factor, m.level AS level, m.mean_score AS mean_score FROM (SELECT factor, max({'mean_score': mean_score, 'level': level}) AS m FROM (SELECT factor, level, round(avg(m)") + ") GROUP BY factor)")
def best_level_names(spark: SparkSession, d: str) -> DataFrame:
    return X.best_level_by_name(factor_breakdown(spark, d))


@query("SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS n_sharp, count(*) FILTER (WHERE l_returnflag = 'N') AS n_smooth, count(*) FILTER (WHERE l_returnflag = 'A') AS n_seam FROM lineitem")
def edge_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "sharp").when(F.col("l_returnflag") == "N", "smooth").when(F.col("l_returnflag") == "A", "seam")
    return topology.feature_counts(table(spark, d, "lineitem").select(kind.alias("feature")))


@query("SELECT DISTINCT l_orderkey AS eid FROM lineitem WHERE l_quantity > 45 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def focused_marks(spark: SparkSession, d: str) -> DataFrame:
    marked = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("eid")).distinct()
    return topology.focused(marked, table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("eid")))


@query("""SELECT pid FROM (SELECT c_custkey AS pid, round(c_nationkey * 1.0::DOUBLE, 6) AS x, round(c_custkey % 10 * 1.0::DOUBLE, 6) AS y, round(c_custkey % 3 * 1.0::DOUBLE, 6) AS z FROM customer) c
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE round(s_nationkey * 1.0::DOUBLE, 6) = x AND round(s_suppkey % 10 * 1.0::DOUBLE, 6) = y AND round(s_suppkey % 3 * 1.0::DOUBLE, 6) = z)""")
def points_without_twin(spark: SparkSession, d: str) -> DataFrame:
    at = lambda n, k: [(F.col(n) * 1.0).alias("x"), (F.col(k) % 10 * 1.0).alias("y"), (F.col(k) % 3 * 1.0).alias("z")]
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), *at("c_nationkey", "c_custkey"))
    return topology.without_points(c, table(spark, d, "supplier").select(*at("s_nationkey", "s_suppkey"))).select("pid")


@query("SELECT p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part) WHERE r <= greatest(8, floor(0.3::DOUBLE * n))")
def capped_marks(spark: SparkSession, d: str) -> DataFrame:
    return topology.capped(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"], 0.3)


def _customers_and_triangles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as points (pid, x, y, z), suppliers as the right corner of a triangle with sides of 6."""
    at = lambda n, k, b: [(F.col(b) / 100).alias("x"), (F.col(n) * 4.0).alias("y"), (F.col(k) % 50 * 1.0).alias("z")]
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), *at("c_nationkey", "c_custkey", "c_acctbal"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tid"), *at("s_nationkey", "s_suppkey", "s_acctbal"))
    corner = lambda n, dx, dy: [(F.col("x") + dx).alias(f"{n}x"), (F.col("y") + dy).alias(f"{n}y"), F.col("z").alias(f"{n}z")]
    return p, t.select("tid", *corner("a", 0.0, 0.0), *corner("b", 6.0, 0.0), *corner("c", 0.0, 6.0))


@query("""WITH p AS (SELECT c_custkey AS pid, c_acctbal / 100 AS x, c_nationkey * 4.0 AS y, (c_custkey % 50) * 1.0 AS z FROM customer), t AS (SELECT s_suppkey AS tid, s_acctbal / 100 AS x, s_nationkey * 4.0 AS y, (s_suppkey % 50) * 1.0 AS z FROM supplier),
d AS (SELECT pid, tid, p.x - t.x AS x, p.y - t.y AS y, p.z - t.z AS z FROM p, t),
e AS (SELECT *, greatest(0, least(1, (6 - x + y) / 12)) AS h FROM d),
q AS (SELECT pid, tid, z * z + CASE WHEN x >= 0 AND y >= 0 AND x + y <= 6 THEN 0 ELSE least(pow(x - greatest(0, least(6, x)), 2) + y * y, x * x + pow(y - greatest(0, least(6, y)), 2), pow(x - 6 + 6 * h, 2) + pow(y - 6 * h, 2)) END AS d2 FROM e)
SELECT pid, round(sqrt(min(d2)), 6) AS distance FROM q GROUP BY pid""")
def surface_distance(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points, suppliers as the right corner of a triangle with sides of 6."""
    from .operators import surface

    p, t = _customers_and_triangles(spark, d)
    found = surface.closest_on_surface(p, t, 8.0, saver(spark, "surface"), only_distance=True)
    return found.select("pid", F.round(F.sqrt("d2"), 6).alias("distance"))


@query("""WITH r AS (SELECT c_custkey AS rid, c_acctbal / 100 + 0.00005 AS x, c_nationkey * 4.0::DOUBLE + 0.1 AS y, (c_custkey % 50) * 1.0::DOUBLE + 0.25 AS z FROM customer),
t AS (SELECT s_acctbal / 100 AS x, s_nationkey * 4.0::DOUBLE AS y, (s_suppkey % 50) * 1.0::DOUBLE AS z FROM supplier),
h AS (SELECT rid, (t.z - r.z) * 1.5 AS t, r.x + (t.z - r.z) - t.x AS u, r.y + (t.z - r.z) / 2 - t.y AS v FROM r JOIN t ON t.z > r.z)
SELECT rid, round(min(t), 6) AS t FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 6 AND t <= 60 GROUP BY rid""")
def ray_first_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first supplier's triangle that a ray from each customer meets within 60."""
    from .operators import walks

    p, t = _customers_and_triangles(spark, d)
    shift = {"x": 0.00005, "y": 0.1, "z": 0.25}
    rays = p.select(F.col("pid").alias("rid"), *[(F.col(c) + s).alias(f"o{c}") for c, s in shift.items()], *[F.lit(v / 3).alias(f"d{c}") for c, v in zip("xyz", (2.0, 1.0, 2.0), strict=True)])
    return walks.ray_hits(rays, t, 4.0, 60.0, saver(spark, "rays")).select("rid", F.round("t", 6).alias("t"))


@query("""WITH p AS (SELECT c_custkey AS pid, c_acctbal / 100 AS x, c_nationkey * 4.0::DOUBLE AS y, (c_custkey % 50) * 1.0::DOUBLE AS z FROM customer),
s AS (SELECT s_acctbal / 100 + 6 AS x, s_nationkey * 4.0::DOUBLE AS y, (s_suppkey % 50) * 1.0::DOUBLE AS z FROM supplier WHERE s_suppkey % 3 > 0),
q AS (SELECT pid, p.x - s.x AS x, p.y - s.y AS y, p.z - s.z AS z, greatest(0, least(1, (p.y - s.y - p.x + s.x) / 12)) AS h FROM p CROSS JOIN s),
m AS (SELECT pid, sqrt(min(pow(x + 6 * h, 2) + pow(y - 6 * h, 2) + z * z)) AS distance FROM q GROUP BY pid)
SELECT pid, round(distance, 6) AS distance, (SELECT round(max(distance), 6) FROM m) AS farthest FROM m""")
def edge_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's distance to the nearest long side of the triangles of two suppliers in three, and the largest of them."""
    from .operators import walks

    p, t = _customers_and_triangles(spark, d)
    edges = t.select(F.col("tid").alias("sid"), *[F.col(f"{n}{c}").alias(f"{m}{c}") for m, n in ("ab", "bc") for c in "xyz"])
    save = saver(spark, "edges")
    found = save(walks.closest_edge(p, edges, 8.0, save, F.col("sid") % 3 > 0).select("pid", F.round(F.sqrt("d2"), 6).alias("distance")))
    return found.crossJoin(F.broadcast(found.agg(F.max("distance").alias("farthest"))))  # one row


@query("""WITH c AS (SELECT CAST(least(15, floor((c_acctbal + 1000) / 11000 * 16)) AS BIGINT) AS i, CAST(c_nationkey % 16 AS BIGINT) AS j, CAST(c_custkey % 16 AS BIGINT) AS k, (c_acctbal + 1000) / 11000 * 16 AS x, c_nationkey % 16 + 0.3 AS y, c_custkey % 16 + 0.4 AS z, c_mktsegment = 'BUILDING' AS seed FROM customer),
s AS (SELECT (s_acctbal + 1000) / 11000 * 16 AS x, s_nationkey % 16 + 0.3 AS y, s_suppkey % 16 + 0.4 AS z FROM supplier),
cell AS (SELECT DISTINCT i, j, k FROM c), step AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) v(a, b, c)),
skin AS (SELECT i, j, k, count(n) < 6 AS open FROM (SELECT o.i, o.j, o.k, m.i AS n FROM cell o CROSS JOIN step LEFT JOIN cell m ON m.i = o.i + a AND m.j = o.j + b AND m.k = o.k + c) GROUP BY 1, 2, 3),
near AS (SELECT i, j, k, bool_or(seed AND pow(x - i - 0.5, 2) + pow(y - j - 0.5, 2) + pow(z - k - 0.5, 2) <= 1.1 * 1.1) AS two FROM (SELECT cell.*, c.x, c.y, c.z, c.seed FROM cell JOIN c ON abs(c.x - cell.i) < 3 AND abs(c.y - cell.j) < 3 AND abs(c.z - cell.k) < 3) GROUP BY 1, 2, 3),
edge AS (SELECT DISTINCT cell.* FROM cell JOIN s ON pow(x - i - 0.5, 2) + pow(y - j - 0.5, 2) + pow(z - k - 0.5, 2) <= 1.3 * 1.3)
SELECT i, j, k, CAST(CASE WHEN two THEN 2 WHEN open OR edge.i IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS level FROM cell JOIN skin USING (i, j, k) LEFT JOIN near USING (i, j, k) LEFT JOIN edge USING (i, j, k)""")
def graded_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the cells that hold customers: open cells and those near suppliers are halved once, those near some customers twice."""
    from .plans.graded import cell_levels

    counts, save = (16, 16, 16), saver(spark, "levels")
    at = lambda p: [((F.col(f"{p}_acctbal") + 1000) / 11000 * 16).alias("x"), (F.col(f"{p}_nationkey") % 16 + 0.3).alias("y"), (F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key") % 16 + 0.4).alias("z")]
    points = table(spark, d, "customer").select(*at("c"), "c_mktsegment")
    cells = points.select(*[F.least(F.lit(15), F.floor(c)).cast("long").alias(n) for c, n in zip("xyz", "ijk", strict=True)]).distinct()
    inside = save(cells.select(((F.col("k") * 16 + F.col("j")) * 16 + F.col("i")).alias("cell"), "i", "j", "k"))
    levels = cell_levels(inside, counts, 1.0, save, 1, table(spark, d, "supplier").select(*at("s")), 1.3, points.filter("c_mktsegment = 'BUILDING'").select("x", "y", "z"), 1.1)
    return levels.select("i", "j", "k", F.col("level").cast("int").alias("level"))


@query("""WITH f AS (SELECT l_orderkey AS box, l_linenumber * 1000000 + l_partkey AS fid, l_extendedprice AS x, l_quantity AS area, CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.1 END AS align FROM lineitem),
u AS (SELECT box, fid, any_value(x) AS x, any_value(area) AS area, any_value(align) AS align, count(*) AS c FROM f GROUP BY box, fid HAVING count(*) = 1),
k AS (SELECT *, bool_or(align > 0.5) OVER (PARTITION BY box) AS found FROM u), g AS (SELECT * FROM k WHERE NOT found OR align > 0.5),
w AS (SELECT *, sum(area) OVER o AS acc, row_number() OVER o AS rn, sum(area) OVER (PARTITION BY box) AS total FROM g WINDOW o AS (PARTITION BY box ORDER BY x + 0.1 * align DESC, fid ROWS UNBOUNDED PRECEDING)),
m AS (SELECT box, min({'e': abs(acc - 60), 'rn': rn}).rn AS cut FROM w GROUP BY box)
SELECT w.box, fid, area FROM w JOIN m ON m.box = w.box WHERE total <= 1.05 * 60 OR rn <= cut""")
def load_selection(spark: SparkSession, d: str) -> DataFrame:
    """All lines as faces, an order as a box with a traction along x and an expected area of 60."""
    from .operators import surface

    line = table(spark, d, "lineitem")
    own = [F.col("l_extendedprice").alias("x"), F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.1).alias("nx"), F.col("l_quantity").alias("area")]
    f = line.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("fid"), *own)
    f = f.groupBy("o", "fid").agg(F.count("*").alias("c"), *[F.first(c).alias(c) for c in ("x", "nx", "area")]).filter("c = 1")
    save = saver(spark, "loads")
    f = save(f.select("fid", "x", F.col("o").cast("double").alias("y"), "nx", "area")).withColumns({c: F.lit(0.0) for c in ("z", "ny", "nz")})
    boxes = line.select(F.col("l_orderkey").alias("box")).distinct().select("box", F.lit(-1e12).alias("lo_x"), F.lit(1e12).alias("hi_x"), (F.col("box") - 0.5).alias("lo_y"), (F.col("box") + 0.5).alias("hi_y"), F.lit(-1.0).alias("lo_z"), F.lit(1.0).alias("hi_z"), F.lit(2.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.5).alias("least_dot"), F.lit(60.0).alias("expected_area"))
    return surface.load_faces(f, boxes, save)


_CORNERS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem"


@query(f"""WITH l AS ({_CORNERS}), c AS (SELECT *, sqrt(y * y * z * z + x * x * z * z + x * x * y * y) AS n, greatest(0, least(1, (50 * x + 8 * y + 8 * z) / 2628)) AS t, abs(x - 25) AS u, abs(y - 5) * 4 AS v, 1 + z AS h FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(n / 2, 6) AS area, round(CASE WHEN n > 0 THEN x * y / n ELSE 1 END, 6) AS normal_z, round((x * y + sqrt(y * y * z * z + x * x * z * z + x * x * y * y)) / 2, 6) AS quad,
round(x / 3, 6) AS mid_x, round(x * l_discount / ((1 + l_discount) * (1 - 2 * l_discount)), 6) AS lame_first, round(x / (2 * (1 + l_discount)), 6) AS lame_second, round(sqrt(pow(x - 1, 2) + pow(y - 2, 2)), 6) AS radius, round(atan2(y - 2, x - 1), 6) AS angle, z - 3 AS height,
CASE WHEN u >= v AND u >= z THEN 0 WHEN v >= z THEN 1 ELSE 2 END AS axis, round(CASE WHEN y > 0 THEN 2 * x * y / (x * y * sqrt(x * x + y * y)) ELSE 0 END, 6) AS menger, round(50 * t, 6) AS foot_x, round(pow(x - 50 * t, 2) + pow(y - 8 * t, 2) + pow(z - 8 * t, 2), 6) AS foot_d2,
round(1 / (h * h * h), 6) AS density, round(greatest(0.5, least(3, 0.5 + 0.07 * x)), 6) AS graded, round(0.5 + 2.5 * greatest(0, least(1, x / 40)), 6) AS blended, round(greatest(0.1, least(4, least(coalesce(0.3 / nullif(y, 0), 4), 0.35 * z))), 6) AS feature FROM c""")
def geometry_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Each line as the legs of a corner: areas, normals, elastic constants, cylindrical places, curvature, nearest points and sizes."""
    df = table(spark, d, "lineitem").withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount") * 100, "z": F.col("l_tax") * 100})
    x, y, z, o = F.col("x"), F.col("y"), F.col("z"), F.lit(0.0)
    a, b, c, zero = (x, o, o), (o, y, o), (o, o, z), (o, o, o)
    end, fixed = tuple(map(F.lit, (50.0, 8.0, 8.0))), lambda *v: tuple(map(F.lit, v))
    first, second = G.lame(x, F.col("l_discount"))
    radius, angle, height = G.cylindrical((x, y, z), fixed(1.0, 2.0, 3.0), 2)
    six = {
        "area": G.triangle_area(a, b, c), "normal_z": G.triangle_normal(a, b, c)[2], "quad": G.quad_area(zero, a, (x, y, o), (o, y, z)), "mid_x": G.centroid(a, b, c)[0], "lame_first": first, "lame_second": second, "radius": radius, "angle": angle,
        "menger": G.menger_curvature(zero, a, b), "foot_x": G.closest_on_segment((x, y, z), zero, end)[0], "foot_d2": G.segment_distance2((x, y, z), zero, end), "density": G.density(1 + z),
        "graded": G.graded_size(F.lit(0.5), F.lit(0.07), x, F.lit(3.0)), "blended": G.blended_size(F.lit(0.5), F.lit(3.0), x, F.lit(40.0)), "feature": G.feature_size(y, z, 0.3, 0.35, F.lit(0.1), F.lit(4.0)),
    }
    axis = G.dominant_axis((x - 25, (y - 5) * 4, z))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[F.round(v, 6).alias(k) for k, v in six.items()], height.alias("height"), axis.alias("axis"))


_MESHER_SQL = "(VALUES (0, 'tet_fill', 'tet'), (1, 'graded', 'graded_tet'), (2, 'zoo', 'hybrid'), (3, 'hex', 'hex'), (4, 'sweep', 'prism'), (5, 'octahedral', 'octa'), (6, 'vary', 'varyhedron'), (7, 'transition', 'hexpyr')) m(n, name, own)"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 8 AS n, o_orderkey % 41 / 20 - 1 AS dial, 1 + o_custkey % 3 AS layers, CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 900 * 1.0 ELSE o_orderkey % 900 * 1000.0 END AS ms FROM orders),
t AS (SELECT o.*, m.own, CASE WHEN abs(dial) < 1e-12 OR m.own IN ('prism', 'octa', 'hexpyr') THEN m.own WHEN dial <= -0.5 THEN 'hex' WHEN dial <= 0.25 THEN 'hybrid' WHEN dial <= 0.75 THEN 'hybrid_vem' ELSE 'graded_tet' END AS shape FROM o JOIN {_MESHER_SQL} USING (n))
SELECT o_orderkey, own AS mesher, shape, CAST(CASE WHEN abs(dial) < 1e-12 THEN layers WHEN shape = 'hybrid' AND dial < 0 THEN greatest(1, layers - 1) WHEN shape = 'graded_tet' AND dial > 0.75 THEN layers + 1 ELSE layers END AS BIGINT) AS skin,
o_custkey % 5 = 0 AND o_custkey % 3 <= 1 AND o_totalprice <= 200000 AND o_orderkey % 2 = 0 AS healthy,
CASE WHEN o_totalprice > 120000 THEN 'sizing' WHEN (o_custkey * 80 > 80000 OR o_custkey * 50 > 60000) AND o_custkey * 50 > 3 * o_totalprice THEN 'mesher' WHEN o_custkey * 80 > 80000 OR o_custkey * 50 > 60000 THEN 'budget' WHEN o_orderkey % 3000 > (CASE WHEN o_orderkey % 7 = 0 THEN 100 WHEN o_orderkey % 3 = 2 THEN 2700 ELSE 900 END) THEN 'wall_clock' END AS verdict,
(CASE WHEN o_orderkey % 7 = 0 THEN 100 WHEN o_orderkey % 3 = 2 THEN 2700 ELSE 900 END)::DOUBLE AS wall, CASE n WHEN 0 THEN 'ok' WHEN 1 THEN 'solve_fail' ELSE 'unknown' END AS state,
printf('%.1f%%', o_custkey % 1000 / 1000 * 100) AS share, CASE WHEN ms >= 10000 THEN printf('%.1fs', ms / 1000) WHEN ms >= 1000 THEN printf('%.2fs', ms / 1000) ELSE printf('%.0fms', ms) END AS took,
CASE n WHEN 0 THEN 'bool' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'str' END AS level_kind, CASE n WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN o_custkey::DOUBLE WHEN 2 THEN o_custkey + 0.5 END AS level_number,
CASE WHEN n < 2 THEN o_totalprice WHEN n < 4 THEN 2 * o_totalprice WHEN n < 6 THEN o_totalprice / (1 + o_custkey % 4) ELSE CASE WHEN o_orderkey % 3 = 0 THEN 7.0 ELSE 9.0 END END AS probe FROM t""")
def scoring_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a run: mesher names, the shape dial, health, budgets, states, formats, levels and probes."""
    o = table(spark, d, "orders")
    key, cust, price, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderkey") % 8
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (n + 1).cast("int"))
    own = scoring.mesher(pick("tet_fill", "graded", "zoo", "hex", "sweep", "octahedral", "vary", "transition"))
    shape, skin = scoring.tendency(own, key % 41 / 20 - 1, 1 + cust % 3)
    ms = F.when(cust % 4 == 0, cust % 900 * 1.0).otherwise(key % 900 * 1000.0)
    wall = scoring.wall_limit(key % 3, F.when(key % 7 == 0, 100.0))
    text = F.when(n == 0, "True").when(n == 1, cust.cast("string")).when(n == 2, F.concat(cust.cast("string"), F.lit(".5"))).otherwise("fine")
    level = scoring.level_value(text)
    kind = pick("max_vm", "max_von_mises", "energy", "strain_energy", "scf", "scf_mean", "mean_ux_on_face", "mean_ux_on_face")
    answers = {"sigma_max": price, "strain_energy": 2 * price, "sigma_face_mean": price, "sigma_p99": price, "tip_deflection": price, "dominant_load_axis": key % 3, "mean_u_component": F.lit(7.0), "mean_ux": F.lit(9.0), "mean_uz": F.lit(11.0)}
    healthy = scoring.healthy(cust % 5, F.when(cust % 3 <= 1, 1e-7).otherwise(1e-5), price / 4e6, key % 2 == 0)
    verdict = scoring.over_budget(price, cust * 80, cust * 50, key % 3000, wall)
    return o.select(
        "o_orderkey", own.alias("mesher"), shape.alias("shape"), skin.cast("long").alias("skin"), healthy.alias("healthy"), verdict.alias("verdict"), wall.alias("wall"), scoring.run_state(pick("ok", "solve_fail", "odd", "x", "y", "z", "", "OK")).alias("state"),
        scoring.percent(cust % 1000 / 1000).alias("share"), scoring.milliseconds(ms).alias("took"), level["kind"].alias("level_kind"), level["number"].alias("level_number"), scoring.probe(kind, (1 + cust % 4).cast("double"), answers).alias("probe"),
    )


_TRIPLE = "SELECT s_suppkey AS tid, [s_suppkey, s_suppkey + 1, s_suppkey + 2, s_suppkey + 5] AS nodes FROM supplier"


@query(f"""WITH n AS ({_CLOUD}), e AS (SELECT tid, least(nodes[p], nodes[q]) AS a, greatest(nodes[p], nodes[q]) AS b FROM ({_TRIPLE}) CROSS JOIN (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) v(p, q)),
d AS (SELECT tid, a, b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS l FROM e JOIN n p ON p.sid = a JOIN n q ON q.sid = b), m AS (SELECT tid, min({{'m': -l, 'a': a, 'b': b}}) AS s FROM d GROUP BY tid)
SELECT tid AS eid, s.a AS a, s.b AS b, round(-s.m, 9) AS len2 FROM m""")
def longest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The longest edge of a tetrahedron of customers at each supplier."""
    key = F.col("s_suppkey")
    elements = table(spark, d, "supplier").select(key.alias("eid"), F.array(key, key + 1, key + 2, key + 5).alias("nodes"))
    out = topology.longest_edge(elements, _cloud(spark, d).withColumnRenamed("sid", "nid"), [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])
    return out.withColumn("len2", F.round("len2", 9))


@query(f"""WITH p AS (SELECT c.*, c_nationkey AS edge FROM ({_CLOUD}) c JOIN customer ON c_custkey = sid)
SELECT a.sid AS pid, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))), 9) AS gap FROM p a JOIN p b ON a.edge <> b.edge AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05 * 0.05 GROUP BY 1""")
def other_edges_gap(spark: SparkSession, d: str) -> DataFrame:
    """Customers as samples of their nation's edge: the gap to the nearest sample of another edge within 0.05."""
    samples = _cloud(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_nationkey").alias("edge")), "sid")
    return spatial.other_edges_gap(samples, 0.05).withColumn("gap", F.round("gap", 9))


@query(f"""WITH p AS ({_CLOUD}), l AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a JOIN p b ON a.sid < b.sid),
s AS (SELECT coalesce(sum(pi() * pow(0.06 - d, 2) * (d * d + 0.12 * d) / (12 * d)) FILTER (WHERE d <= 0.06), 0) AS lens FROM l) SELECT round(greatest(0, least(1, (SELECT count(*) FROM p) * 4 / 3 * pi() * 0.03 * 0.03 * 0.03 - lens)), 9) AS fill FROM s""")
def packing_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of the unit box that balls around all customers fill, less the lenses of pairs."""
    return spatial.packing_fill(_cloud(spark, d), 0.03, 1.0).withColumn("fill", F.round("fill", 9))


@query("""WITH t AS (SELECT s_suppkey AS tid, s_acctbal / 100 + 0.003 AS x, s_nationkey * 4.0::DOUBLE + 0.3 AS y, (s_suppkey % 50) * 1.0::DOUBLE AS z FROM supplier),
c AS (SELECT tid, i, j, x, y, z, (i + 0.5) * 2 - x AS u, (j + 0.5) * 2 - y AS v FROM t, generate_series(-10, 60) a(i), generate_series(-5, 60) b(j))
SELECT i, j, round(z + u / 2, 6) AS z FROM c WHERE u >= 0 AND v >= 0 AND u + v <= 6""")
def columns_under(spark: SparkSession, d: str) -> DataFrame:
    """Where the lattice columns' centres meet the suppliers' triangles, which rise by a half along x."""
    _, t = _customers_and_triangles(spark, d)
    t = t.withColumns({**{f"{n}x": F.col(f"{n}x") + 0.003 for n in "abc"}, **{f"{n}y": F.col(f"{n}y") + 0.3 for n in "abc"}, "bz": F.col("bz") + 3.0})
    return spatial.columns_under(t, 2.0).withColumn("z", F.round("z", 6))


@query(f"""WITH p AS (SELECT c.*, sin(sid) AS nx, cos(sid) AS ny FROM ({_CLOUD}) c)
SELECT a.sid AS pid, round(max(abs(a.nx * b.nx + a.ny * b.ny)), 9) AS best FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.06 * 0.06 WHERE b.sid % 3 = 0 AND abs(a.nx * b.nx + a.ny * b.ny) >= 0.866 GROUP BY 1""")
def best_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The best agreement of each customer's direction with one of three within 0.06."""
    p = _cloud(spark, d).select("sid", "x", "y", "z", F.sin("sid").alias("nx"), F.cos("sid").alias("ny"), F.lit(0.0).alias("nz"))
    return spatial.best_alignment(p.withColumnRenamed("sid", "pid"), p.filter("sid % 3 = 0"), 0.06).withColumn("best", F.round("best", 9))


_STRIP = f"""n AS ({_CLOUD}), w AS (SELECT s_suppkey AS tid, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM supplier JOIN n a ON a.sid = s_suppkey JOIN n b ON b.sid = s_suppkey + 1 JOIN n c ON c.sid = s_suppkey + 2),
c AS (SELECT tid, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM w), t AS (SELECT tid, sqrt(cx * cx + cy * cy + cz * cz) / 2 AS area, cx / sqrt(cx * cx + cy * cy + cz * cz) AS nx, cy / sqrt(cx * cx + cy * cy + cz * cz) AS ny, cz / sqrt(cx * cx + cy * cy + cz * cz) AS nz FROM c),
e AS (SELECT t.*, tid + p AS a, tid + q AS b FROM t CROSS JOIN (VALUES (0, 1), (1, 2), (0, 2)) v(p, q)),
g AS (SELECT a, b, count(*) AS n, acos(greatest(-1, least(1, min_by(nx, tid) * max_by(nx, tid) + min_by(ny, tid) * max_by(ny, tid) + min_by(nz, tid) * max_by(nz, tid)))) AS theta FROM e GROUP BY a, b)"""


def _strip(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(triangles: tid, nodes, area, nx, ny, nz; vertices) of a strip: each supplier spans three customers, two of them with the next."""
    from .operators.surface import triangles_of

    key = F.col("s_suppkey")
    own = table(spark, d, "supplier").select(key.alias("tid"), F.array(key, key + 1, key + 2).alias("nodes"))
    vertices = _cloud(spark, d).withColumnRenamed("sid", "vid")
    corners = [G.vec(n) for n in "abc"]
    t = triangles_of(own, vertices).select("tid", G.triangle_area(*corners).alias("area"), *[v.alias(f"n{c}") for c, v in zip("xyz", G.triangle_normal(*corners), strict=True)])
    return own.join(t, "tid"), vertices


@query(f"WITH {_STRIP} SELECT a, b, n, CASE WHEN n = 2 THEN round(theta, 6) END AS dihedral FROM g WHERE n = 1 OR theta > radians(30)")
def sharp_edges(spark: SparkSession, d: str) -> DataFrame:
    """Open edges of the strip and those that it bends at by more than 30 degrees."""
    return topology.sharp_edges(_strip(spark, d)[0], 30.0).withColumn("dihedral", F.round("dihedral", 6))


@query(f"""WITH {_STRIP}, r AS (SELECT tid + k AS vid, sum(area) / 3 AS ring, sum(area * nx) AS sx, sum(area * ny) AS sy, sum(area * nz) AS sz FROM t CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY 1),
l AS (SELECT g.a, g.b, theta * sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS turn FROM g JOIN n p ON p.sid = g.a JOIN n q ON q.sid = g.b WHERE g.n = 2), m AS (SELECT vid, sum(turn) AS turn FROM (SELECT a AS vid, turn FROM l UNION ALL SELECT b, turn FROM l) GROUP BY vid)
SELECT r.vid, round(coalesce(turn, 0) / (4 * ring), 6) AS kappa, round(sz / sqrt(sx * sx + sy * sy + sz * sz), 6) AS normal_z FROM r LEFT JOIN m ON m.vid = r.vid""")
def vertex_curvature(spark: SparkSession, d: str) -> DataFrame:
    """Curvature and normal of the strip's vertices."""
    t, vertices = _strip(spark, d)
    kappa, normal = fields.vertex_curvature(t, vertices), fields.vertex_normals(t)
    return kappa.join(normal, "vid").select("vid", F.round("kappa", 6).alias("kappa"), F.round("nz", 6).alias("normal_z"))


def _tets(spark: SparkSession, d: str) -> DataFrame:
    """A row of tetrahedra: each supplier spans four customers, three of them with the next."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(key.alias("eid"), F.lit("tet4").alias("etype"), F.array(*[key + k for k in range(4)]).alias("nodes"), F.lit(None).cast("array<array<int>>").alias("faces"))


_TETS = """f AS (SELECT s_suppkey AS eid, local, s_suppkey + p AS p, s_suppkey + q AS q, s_suppkey + r AS r, list_sort([s_suppkey + p, s_suppkey + q, s_suppkey + r]) AS face FROM supplier CROSS JOIN (VALUES (0, 1, 2, 3), (1, 0, 3, 2), (2, 0, 1, 3), (3, 0, 2, 1)) v(local, p, q, r)),
k AS (SELECT *, count(*) OVER (PARTITION BY face) AS n FROM f)"""


@query(f"WITH {_TETS} SELECT eid, local, p, q, r FROM k WHERE n = 1")
def boundary_skin(spark: SparkSession, d: str) -> DataFrame:
    """Faces of one tetrahedron only, in its orientation."""
    skin = topology.boundary_skin(topology.faces(_tets(spark, d)))
    return skin.select("eid", "local", *[F.element_at("nodes", i + 1).alias(c) for i, c in enumerate("pqr")])


@query(f"WITH {_TETS} SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM (SELECT p AS u, q AS v FROM k WHERE n = 1 UNION ALL SELECT q, r FROM k WHERE n = 1 UNION ALL SELECT r, p FROM k WHERE n = 1)")
def skin_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges of those faces."""
    return topology.skin_edges(_tets(spark, d))


@query(f"WITH {_TETS} SELECT min(eid) AS a, max(eid) AS b FROM k WHERE n = 2 GROUP BY face")
def face_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours: tetrahedra that share a face."""
    return topology.face_pairs(topology.faces(_tets(spark, d)))


@query(f"""WITH n AS ({_CLOUD}), e AS (SELECT s_suppkey + p AS a, s_suppkey + q AS b, min(s_suppkey * 6 + pos) AS first FROM supplier CROSS JOIN (VALUES (0, 0, 1), (1, 1, 2), (2, 0, 2), (3, 0, 3), (4, 1, 3), (5, 2, 3)) v(pos, p, q) GROUP BY 1, 2)
SELECT sid AS nid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM n UNION ALL
SELECT (SELECT max(sid) FROM n) + row_number() OVER (ORDER BY first), round((p.x + q.x) / 2, 9), round((p.y + q.y) / 2, 9), round((p.z + q.z) / 2, 9) FROM e JOIN n p ON p.sid = a JOIN n q ON q.sid = b""")
def midpoints(spark: SparkSession, d: str) -> DataFrame:
    """All customers, and a node at the middle of each edge of the tetrahedra, numbered as first met."""
    nodes, _ = topology.midpoints(_tets(spark, d), _cloud(spark, d).withColumnRenamed("sid", "nid"), [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)])
    return nodes.select("nid", *[F.round(c, 9).alias(c) for c in "xyz"])


@query(f"""WITH n AS ({_CLOUD}), m AS (SELECT min(x) AS lo, max(x) AS hi FROM n), r AS (SELECT sid FROM n, m WHERE x >= hi - 0.0255)
SELECT 'held' AS kind, sid * 3 + k AS dof, 0.0::DOUBLE AS value FROM n, m, (VALUES (0), (1), (2)) v(k) WHERE x <= lo + 0.0255 UNION ALL SELECT 'load', sid * 3, round(1000.0::DOUBLE / (SELECT count(*) FROM r), 9) FROM r""")
def slab_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Customers of the least x are held, those of the greatest share a load."""
    held, load = fields.slab_conditions(_cloud(spark, d).withColumnRenamed("sid", "nid"), 0.05, 1000.0)
    return held.select(F.lit("held").alias("kind"), "dof", "value").unionByName(load.select(F.lit("load").alias("kind"), F.col("i").alias("dof"), F.round("val", 9).alias("value")))


@query("""WITH c AS (SELECT round(max(l_tax / (pow(l_quantity / 10, 2) * l_discount / 8)), 6) AS efficiency_max FROM lineitem WHERE l_discount > 0),
u AS (SELECT round(avg(sqrt(p_size * p_size + p_retailprice * p_retailprice + 1)) FILTER (WHERE p_size < 10), 6) AS face_mean, round(avg(p_size) FILTER (WHERE p_size < 10), 6) AS face_component, round(max(sqrt(p_size * p_size + p_retailprice * p_retailprice + 1)), 6) AS global_max FROM part),
s AS (SELECT count(*) FILTER (WHERE p_size < 20) AS n_short, count(*) FILTER (WHERE p_size / 10 / 3 < 0.25) AS n_flagged FROM part WHERE p_partkey % 3 = 0), t AS (SELECT round(max(sqrt(l_tax)), 6) AS max, round(avg(sqrt(l_tax)), 6) AS mean, count(*) AS n, count(*) FILTER (WHERE l_tax = 0) AS n_on FROM lineitem) SELECT * FROM c, u, s, t""")
def field_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One row: chordal efficiency, face displacements, short features and conformity of given columns."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    chord = fields.chordal_efficiency(line.select(F.col("l_tax").alias("d"), (F.col("l_quantity") / 10).alias("length"), F.col("l_discount").alias("kappa")))
    u = part.select(F.col("p_partkey").alias("nid"), F.col("p_size").cast("double").alias("ux"), F.col("p_retailprice").alias("uy"), F.lit(1.0).alias("uz"))
    moved = fields.displacement_summary(u, part.filter("p_size < 10").select(F.col("p_partkey").alias("nid")), "ux")
    short, _ = fields.short_features(part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "sharp").otherwise("smooth").alias("feature"), (F.col("p_size") / 10).alias("length")), 1.0)
    on = fields.distance_summary(line.select(F.col("l_tax").alias("d2")))
    out = chord.crossJoin(moved).crossJoin(short).crossJoin(on)  # single rows
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("""WITH e AS (SELECT s_suppkey AS eid, CASE WHEN s_suppkey % 7 = 0 THEN [s_suppkey, s_suppkey + 1, s_suppkey + 1, s_suppkey + 3] WHEN s_suppkey % 5 = 0 THEN [s_suppkey, s_suppkey + 1, s_suppkey + 2] WHEN s_suppkey % 11 = 0 THEN [s_suppkey, -s_suppkey, s_suppkey + 1, s_suppkey + 2] ELSE [s_suppkey, s_suppkey + 1, s_suppkey + 2, s_suppkey + 3] END AS nodes FROM supplier)
SELECT eid, CASE WHEN len(nodes) <> 4 THEN 'arity' ELSE 'repeated node' END AS problem FROM e WHERE len(nodes) <> 4 OR len(list_distinct(nodes)) < 4 UNION ALL
SELECT DISTINCT eid, 'unknown node' FROM (SELECT eid, unnest(nodes) AS nid FROM e) WHERE nid NOT IN (SELECT c_custkey FROM customer)""")
def mesh_violations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as tetrahedra of customers, some with too few, repeated or unknown nodes."""
    k = F.col("s_suppkey")
    nodes = F.when(k % 7 == 0, F.array(k, k + 1, k + 1, k + 3)).when(k % 5 == 0, F.array(k, k + 1, k + 2)).when(k % 11 == 0, F.array(k, -k, k + 1, k + 2)).otherwise(F.array(k, k + 1, k + 2, k + 3))
    elements = table(spark, d, "supplier").select(k.alias("eid"), F.lit("tet4").alias("etype"), nodes.alias("nodes"))
    return topology.violations(elements, table(spark, d, "customer").select(F.col("c_custkey").alias("nid")))


for _name in ("embedding_nearest", "hop_distance"):  # under both names they had: each is the whole job
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]
