"""Declared and inferred relations: parsing, conflicts between them, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPT, OVERRIDE = 0.7, 0.9
#: Pairs of types that can stand together and be merged.
COMPATIBLE = [("REQUIRES", "ENHANCES"), ("ENHANCES", "REQUIRES"), ("SUBSTITUTES", "ENHANCES"), ("ENHANCES", "SUBSTITUTES")]
#: Ways to settle a conflict of types, in order; the first that applies holds.
LADDER = ("keep_declared", "manual_review", "merge", "keep_inferred")


def best_per_target(relations: DataFrame) -> DataFrame:
    """The relation of the highest confidence for each (source, target); ties go to the smaller type."""
    w = Window.partitionBy("source", "target").orderBy(F.desc("confidence"), "edge_type")
    return relations.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def resolve(declared: DataFrame, inferred: DataFrame, accept: float = ACCEPT, override: float = OVERRIDE, ladder: tuple[str, ...] = LADDER) -> DataFrame:
    """(source, target, edge_type, confidence, strategy) of declared (source, target, edge_type) and inferred (+ confidence).

    Declared alone is kept; inferred alone is taken from ``accept`` on; where
    both name one type it is declared.  Types in conflict go down the ladder:
    the declared and the review (which keeps the declared meanwhile) always
    apply, a merge for compatible types, the inferred from ``override`` on; where
    nothing applies the declared is kept.
    """
    d = best_per_target(declared.withColumn("confidence", F.lit(1.0))).select("source", "target", F.col("edge_type").alias("dt"))
    i = best_per_target(inferred).select("source", "target", F.col("edge_type").alias("it"), F.col("confidence").alias("ic"))
    both = d.join(i, ["source", "target"], "full_outer")
    pair = F.lit(False)
    for a, b in COMPATIBLE:
        pair = pair | ((F.col("dt") == a) & (F.col("it") == b))
    applies = {"keep_declared": F.lit(True), "manual_review": F.lit(True), "merge": pair, "keep_inferred": F.col("ic") >= override}
    settled = F.coalesce(*(F.when(applies[s], F.lit(s)) for s in ladder), F.lit("keep_declared"))
    strategy = (
        F.when(F.col("it").isNull(), "declared_only")
        .when(F.col("dt").isNull(), F.when(F.col("ic") >= accept, "inferred_accepted").otherwise("inferred_rejected"))
        .when(F.col("dt") == F.col("it"), "agreed")
        .otherwise(settled)
    )
    out = both.withColumn("strategy", strategy).where("strategy <> 'inferred_rejected'")
    own = F.col("strategy").isin("inferred_accepted", "keep_inferred")
    return out.select("source", "target", F.when(own, F.col("it")).otherwise(F.col("dt")).alias("edge_type"), F.when(own, F.col("ic")).otherwise(1.0).alias("confidence"), "strategy")


def summary(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("strategy").agg(F.count("*").alias("n"))


def review(resolved: DataFrame) -> DataFrame:
    """Those that wait for a decision."""
    return resolved.where("strategy = 'manual_review'")


def decide(resolved: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed relations with the type of ``decisions`` (source, target, decided); a null type drops one."""
    d = decisions.select("source", "target", "decided", F.lit(True).alias("hit"))
    out = resolved.join(d, ["source", "target"], "left").where("hit is null or decided is not null")
    return out.select("source", "target", F.coalesce("decided", "edge_type").alias("edge_type"), "confidence", F.when(F.col("hit"), "manual").otherwise(F.col("strategy")).alias("strategy"))
