"""Campaigns: expand a grid of settings, run tiers, halve the field, resume, report."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import config_id
from ..operators.experiments import halving_trim, remaining, work_list


def expand(spark: SparkSession, grid: dict[str, list[str]]) -> DataFrame:
    """Distinct configurations of a grid: cfg (id of its canonical JSON), config (map), sorted by id."""
    df = spark.range(1).select(F.expr("map()").cast("map<string,string>").alias("config"))
    for key in sorted(grid):
        values = F.array(*[F.lit(str(v)) for v in grid[key]])
        df = df.select("config", F.explode(values).alias("v")).select(F.map_concat("config", F.create_map(F.lit(key), F.col("v"))).alias("config"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("config"))))
    return df.select(config_id(text).alias("cfg"), "config").groupBy("cfg").agg(F.first("config").alias("config")).orderBy("cfg")


def run_campaign(spark: SparkSession, configs: DataFrame, parts: DataFrame, tiers: list[float], run_one: Callable[[dict], dict], schema: str, path: str, stop: Callable[[], bool] | None = None) -> DataFrame:
    """Successive halving.  tiers: the share kept after each.  Results are appended below path and read again.

    A tier's due runs (survivors by parts, less those done) go through ``run_one`` in
    mapInPandas, spread over the cluster.  ``stop`` is asked after each tier; a later
    call resumes by the keys in the results.
    """
    import pandas as pd

    def batchwise(batches: Iterable[pd.DataFrame]):
        for b in batches:
            rows = [run_one(r) for r in b.to_dict("records")]
            if rows:
                yield pd.DataFrame(rows)

    def results() -> DataFrame | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.schema(schema).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    alive = configs
    for tier, keep in enumerate(tiers):
        due, done = work_list(alive, parts, [tier]), results()
        if done is not None:
            due = remaining(due, done, ["cfg", "part", "tier"])
        due = due.join(configs, "cfg").repartition("cfg", "part")
        due.mapInPandas(batchwise, schema).write.mode("append").parquet(path)
        if stop and stop():
            break
        scores = results().filter(F.col("tier") == tier).groupBy("cfg").agg(F.avg(F.when(F.col("ok"), F.col("score")).otherwise(F.lit(0.0))).alias("score"))
        alive = configs.join(halving_trim(scores, keep).select("cfg"), "cfg", "left_semi")
    return results()
