"""Readers of run logs, campaign documents, cases and result files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DETAIL = "struct<metric:string,value:double,truth:double,rel_err:double,score:double,trusted:boolean>"
RUN_SCHEMA = f"""
cfg_id string, part string, tier int, status string, config map<string,string>, mesh_ms double, solve_ms double,
n_elems bigint, n_nodes bigint, n_dof bigint,
geom_class struct<curved_frac:double,thin:boolean,min_feature_h:double,n_features_below_h_min:int>,
quality struct<M1max:double,M2max:double,M6:double,score:double>,
accuracy struct<metric:string,value:double,truth:double,rel_err:double,score:double,trusted:boolean,all:array<{DETAIL}>>,
answers map<string,double>,
health struct<free_residual_rel:double,reaction_sum_err:double,n_orphans:int,n_bc_dofs:int,load_area_ok:boolean,load_area_rel_err:double,ok:boolean>,
scorecard struct<edge_hausdorff_over_h:double,chordal_efficiency_max:double,normal_dev_deg_max:double,n_dof:bigint,accuracy_rel_err:double,min_element_quality:double,solve_residual_rel:double,health_ok:boolean>,
feature_flags array<struct<edge_id:int,reason:string,length:double,h_edge:double,h_min:double>>,
h double, n_pred_elems double, over_budget_cause string, error string, wall_time_s double, max_run_wall_s double
"""
CAMPAIGN = "name string, parts array<string>, tiers array<struct<h_scale:double,keep_frac:double>>, grid map<string,array<string>>, score struct<weights:map<string,double>>, warehouse boolean"
CHECKPOINT = "campaign string, state string, tier int, completed_runs int, survivors array<string>, started_utc string, updated_utc string"
PROGRESS = "phase string, phase_frac double, elapsed_ms double, cg_iter int, cg_resid double, n_elems bigint, n_nodes bigint, run struct<cfg_id:string,part:string,tier:int>"
HANDOFF = "campaign string, git_head string, finished_utc string, checkpoint_state string, pareto string, results string, shots array<string>, open_program_nodes array<string>, mode string, max_turns int"
SELECT = "struct<box:array<array<double>>,expected_area:double,normal_min_dot:double>"
CASE = f"part string, geometry string, material struct<E:double,nu:double,rho:double>, bcs array<struct<select:{SELECT},fix:array<boolean>>>, loads array<struct<select:{SELECT},traction:array<double>>>, reference string"
METRICS = f"part string, metrics array<struct<name:string,value:double,tol:double,derivation:string,probe:struct<kind:string,nominal:double,select:{SELECT}>>>"
RESULT = "schema_version int, solver string, version string, case_id string, dofs bigint, label string, timestamp string, notes string, wall_time_s struct<mesh:double,solve:double,total:double>, accuracy struct<name:string,value:double,unit:string>"
REQUIRED = ("solver", "case_id", "label", "timestamp")


def run_log(spark: SparkSession, path: str, mode: str = "warn") -> DataFrame:
    """Run records of a JSONL file or folder.

    warn: blank lines go, corrupt ones stay with their text in _corrupt; skip: they
    go too, as do records without their key; strict: trailing white space and
    comment lines (#) go, and a corrupt line fails the read.
    """
    if mode == "strict":
        lines = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"[\r\t ]+$", "")).alias("line")).filter("line <> '' AND NOT startswith(ltrim(line), '#')")
        return lines.select(F.from_json("line", " ".join(RUN_SCHEMA.split()), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    df = spark.read.schema(RUN_SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if mode == "skip":
        return df.filter("_corrupt IS NULL AND cfg_id IS NOT NULL AND part IS NOT NULL AND tier IS NOT NULL").drop("_corrupt")
    return df


def completed(runs: DataFrame) -> DataFrame:
    """Keys of the runs that are done."""
    return runs.select("cfg_id", "part", "tier").filter("cfg_id IS NOT NULL AND part IS NOT NULL AND tier IS NOT NULL").distinct()


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that are neither blank nor comments."""
    return spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").count()


def scan_campaigns(spark: SparkSession, folder: str) -> DataFrame:
    """Per campaign folder: which files exist, its name, its state and how many result lines; sorted by name."""
    named = lambda df: df.select("value", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    at = F.col("_metadata.file_path").alias("path")
    own = named(spark.read.text(f"{folder}/*/*.jsonl").select("value", at))
    is_line = "file = 'results.jsonl' AND trim(value) <> '' AND NOT startswith(ltrim(value), '#')"
    docs = named(spark.read.text(f"{folder}/*/*.json", wholetext=True).select("value", at)).withColumnRenamed("value", "doc")
    parsed = docs.groupBy("dir").agg(
        F.max(F.when(F.col("file") == "campaign.json", F.get_json_object("doc", "$.name"))).alias("own_name"),
        F.max(F.when(F.col("file") == "checkpoint.json", F.get_json_object("doc", "$.state"))).alias("state"),
        *[F.coalesce(F.bool_or(F.col("file") == f"{n}.json"), F.lit(False)).alias(f"has_{n}") for n in ("campaign", "checkpoint", "progress", "handoff")],
    )
    lines = own.groupBy("dir").agg(F.count_if(F.expr(is_line)).alias("n_results"), F.bool_or(F.col("file") == "results.jsonl").alias("has_results"))
    return lines.join(parsed, "dir", "full_outer").na.fill(0, ["n_results"]).na.fill(False).select(F.coalesce("own_name", "dir").alias("name"), "dir", "state", "n_results", "has_results", "has_campaign", "has_checkpoint", "has_progress", "has_handoff").orderBy("name")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document (CAMPAIGN, CHECKPOINT, PROGRESS, HANDOFF, CASE, METRICS) as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def valid_campaign(campaign: DataFrame) -> DataFrame:
    """Fails unless there is a tier and every keep_frac is in (0, 1]."""
    ok = (F.size("tiers") > 0) & F.forall("tiers", lambda t: (t["keep_frac"] > 0) & (t["keep_frac"] <= 1))
    return campaign.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a campaign needs a tier, and keep_frac in (0, 1]")).cast("boolean")))


def case_rows(case: DataFrame, what: str) -> DataFrame:
    """One row for each entry of bcs or loads, with its box as lo and hi."""
    return case.select("part", F.posexplode(what).alias("n", "e")).select("part", "n", "e.*").withColumn("lo", F.col("select.box")[0]).withColumn("hi", F.col("select.box")[1])


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row a metric; the tolerance is 0.05 unless given.  Fails without metrics."""
    ok = metrics.withColumn("metrics", F.when(F.col("metrics").isNull(), F.raise_error(F.lit("metrics[] is missing")).cast(metrics.schema["metrics"].dataType)).otherwise(F.col("metrics")))
    return ok.select("part", F.explode("metrics").alias("m")).select("part", "m.name", "m.value", F.coalesce("m.tol", F.lit(0.05)).alias("tol"), "m.probe")


def reference_values(text: Column) -> Column:
    """{"values": {...}} as a map of doubles."""
    return F.from_json(text, "values map<string,double>")["values"]


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """Results from files that hold one object, an array, or {"results": [...]}; fails where a required key is missing."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_struct(RESULT)}>>")
    nested = F.from_json("value", f"results array<struct<{_struct(RESULT)}>>")["results"]
    rows = F.when(F.ltrim("value").startswith("["), listed).when(F.get_json_object("value", "$.results").isNotNull(), nested).otherwise(F.array(F.from_json("value", RESULT)))
    out = text.select(F.explode(rows).alias("r")).select("r.*")
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return out.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"a result needs {', '.join(REQUIRED)}")).cast("boolean")))


def _struct(schema: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (x.strip().split(" ", 1) for x in _split(schema)))


def _split(schema: str) -> list[str]:
    """Top-level commas only."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def open_program_nodes(lines: DataFrame) -> DataFrame:
    """Ids of "- id:" lines whose next status line says todo or in_progress.  lines: file, n, value."""
    own = lines.withColumn("id", F.nullif(F.regexp_extract("value", r"^\s*-\s*id:\s*(\S+)", 1), F.lit(""))).withColumn("status", F.nullif(F.regexp_extract("value", r"^\s*status:\s*(\S+)", 1), F.lit("")))
    w = Window.partitionBy("file").orderBy("n")
    own = own.withColumn("of", F.last("id", ignorenulls=True).over(w)).filter("status IS NOT NULL AND of IS NOT NULL")
    first = own.groupBy("file", "of").agg(F.min(F.struct("n", "status")).alias("s"))
    return first.filter("s.status IN ('todo', 'in_progress')").select("file", F.col("of").alias("id"), "s.status")


def mesh_counts(stdout: Column) -> tuple[Column, Column]:
    """Elements and nodes named in a mesher's output."""
    number = lambda word: F.nullif(F.regexp_extract(stdout, rf"(\d+)\s+{word}", 1), F.lit("")).cast("long")
    return number("elem"), number("nodes")


def matching_lines(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """(path, value) of lines that match: a gate over sets of text files."""
    return spark.read.text(paths).filter(F.col("value").rlike(pattern)).select(F.col("_metadata.file_path").alias("path"), "value")


def artifacts(spark: SparkSession, folder: str, glob: str = "*.png", most: int = 40) -> DataFrame:
    """Paths of files below a folder, sorted; a listing for a report, so it has a limit."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path").orderBy("path").limit(most)
