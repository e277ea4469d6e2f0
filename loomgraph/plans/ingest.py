"""Ingestion: from skill files to skills, edges and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import infer_uid
from loomgraph.operators.validation import errors, hint_edges, warnings
from loomgraph.sources.skill_files import manifests, scan


def parse(files: DataFrame, strict: bool = False) -> DataFrame:
    """Files (path, text) with their manifest, the errors found in it and its warnings.

    With ``strict`` the first invalid file ends the job with its path and errors.
    """
    m = manifests(files).withColumn("manifest", F.col("manifest").withField("skill_id", F.coalesce("manifest.skill_id", infer_uid("path"))))
    checked = errors(m, "manifest.")
    broken = F.array(F.concat(F.lit("front_matter:"), "manifest._error"))
    out = checked.withColumn("errors", F.when(F.col("manifest._error").isNotNull(), broken).otherwise(F.col("errors"))).withColumn("is_valid", F.size("errors") == 0)
    out = warnings(out)
    if not strict:
        return out
    reason = F.concat(F.lit("invalid file "), F.col("path"), F.lit(": "), F.array_join("errors", ", "))
    return out.withColumn("is_valid", F.when(F.col("is_valid"), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")))


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skills, edges, errors) of the skill files below a path; invalid files only add errors."""
    rows = parse(scan(spark, path))
    good = rows.where("is_valid")
    skills = good.select(F.col("manifest.skill_id").alias("uid"), "manifest.version", "manifest.intent_description", "manifest.permissions", F.lit(1.0).alias("execution_success_rate"), F.lit(0).cast("long").alias("execution_count"), F.coalesce("manifest.deprecated", F.lit(False)).alias("is_deprecated"), "manifest.tags", "manifest.author")
    edges = hint_edges(good.select(F.col("manifest.skill_id").alias("uid"), F.col("manifest.topology_hints").alias("hints")), "uid", "hints").where("source <> target")
    return skills, edges, rows.where("not is_valid").select("path", F.explode("errors").alias("error"))


def statistics(rows: DataFrame) -> DataFrame:
    """Totals of an import (is_valid): files, imported, failed and the share that came in, in percent."""
    return rows.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("imported"), F.count_if(~F.col("is_valid")).alias("failed"), F.round(F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)) * 100, 2).alias("success_rate"))
