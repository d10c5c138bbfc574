"""The run from a text matrix to a result table: reading, name mapping, checks, scoring, writing."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurigrade.operators import mapping, normalise
from plurigrade.plans import potency
from plurigrade.settings import Settings, usable_cores
from plurigrade.sources import matrix, sinks
from plurigrade.sources.sinks import Stages


@dataclass(frozen=True)
class Names:
    """Tables that map input names to features: ``alias(alias, target)`` and, for human data, ``orthologs(name, ortholog)``."""

    alias: DataFrame
    orthologs: DataFrame | None = None


@dataclass
class Report:
    """What a run says beside its result."""

    n_present: int = 0
    looks_logged: bool = False
    low_counts: bool = False


def mapped(expr: DataFrame, feature: DataFrame, names: Names | None, species: str) -> DataFrame:
    """``cell_id, feature, value`` under the features' names.

    Mouse names that are no features become their alias' target, unless that is in the input itself.  Human names become
    their ortholog, else their alias' target, else go; of names with one target the first in the input stays, where
    ``expr`` has ``gene_idx``, their order, or else the first by name.
    """
    if names is None:
        return expr.select("cell_id", "feature", "value")
    if species == "human":
        if names.orthologs is None:
            raise ValueError("human data need a table of orthologs")
        order = F.min("gene_idx" if "gene_idx" in expr.columns else "feature").alias("gene_idx")
        known = expr.groupBy(F.col("feature").alias("name")).agg(order)
        use = mapping.ortholog_names(known, names.orthologs, names.alias).select("name", "mapped")
    else:
        use = mapping.alias_names(expr.select(F.col("feature").alias("name")).distinct(), names.alias, feature)
    return expr.join(use, expr["feature"] == use["name"]).select("cell_id", F.col("mapped").alias("feature"), "value")


def checked(expr: DataFrame, named: DataFrame, feature: DataFrame, verbose: bool = True) -> Report:
    """Coverage of the features and the two warnings, each from one small aggregate."""
    present = mapping.coverage(named.select(F.col("feature").alias("name")).distinct(), feature).first().n_present
    logged = bool(normalise.looks_logged(expr).first().warn)
    sparse = mapping.aligned(named, feature, strict=False)
    totals = normalise.normalised(sparse, feature.count())
    low = bool(normalise.low_counts(totals, expr.select("cell_id")).first().warn)
    if verbose and logged:
        warnings.warn("the input looks log-transformed; raw counts or counts per million are expected", stacklevel=2)
    if verbose and low:
        warnings.warn("a fifth of the cells or more express fewer than 500 features", stacklevel=2)
    return Report(present, logged, low)


def run(
    spark: SparkSession,
    path: str,
    feature: DataFrame,
    model: dict[str, DataFrame],
    sets: int,
    names: Names | None = None,
    settings: Settings | None = None,
    output: str | None = None,
    stages: Stages | None = None,
    verbose: bool = True,
) -> tuple[DataFrame, Report]:
    """The result table of the genes-by-cells text matrix at ``path``, and what is to say about the input.

    ``feature(feature, feature_idx)`` lists the model's features, ``model`` its tables.  With ``output`` the table is written
    there as text in the cells' order.  ``settings.max_cores`` bounds the partitions of shuffles, and so the tasks of this run.
    """
    settings, stages = settings or Settings(), stages or Stages()
    if settings.max_cores is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(usable_cores(settings.max_cores, spark.sparkContext.defaultParallelism)))
    read = stages.keep("read", matrix.read_matrix(spark, path))
    # Cells without any value are cells too; they fail the run below.
    cells = matrix.read_cells(spark, path)
    expr = stages.keep("mapped", mapped(read.select("cell_id", "feature", "value"), feature, names, settings.species))
    report = checked(read, expr, feature, verbose)
    out = potency.score(expr, feature, model, sets, settings, stages, cells)
    if output:
        out = stages.keep("result", out)
        sinks.write_results(out, output)
    return out, report
