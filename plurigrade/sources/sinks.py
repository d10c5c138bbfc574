"""Sinks: result tables, stage tables, stage timings."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurigrade.functions.scalars import number_text
from plurigrade.sources.shared import settled

HEADER = ("", "score", "potency", "relative", "preknn_score", "preknn_potency")


def result_lines(results: DataFrame, header: tuple[str, ...] = HEADER) -> DataFrame:
    """``at, line``: the header (at -1) and one line per cell (at its ``cell_idx``), tab-separated, missing values empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat_ws("\t", F.col("cell_id").cast("string"), number_text(F.col("score")), blank("potency"), number_text(F.col("relative")), number_text(F.col("preknn_score")), blank("preknn_potency"))
    first = results.sparkSession.createDataFrame([(-1, "\t".join(header))], "at long, line string")
    return first.unionByName(results.select(F.col("cell_idx").cast("long").alias("at"), line.alias("line")))


def write_results(results: DataFrame, path: str, single: bool = False, header: tuple[str, ...] = HEADER) -> None:
    """The result table in the original order of the cells, range-partitioned over files, or in one file."""
    lines = result_lines(results, header)
    ordered = lines.coalesce(1).sortWithinPartitions("at") if single else lines.orderBy("at")
    ordered.select("line").write.mode("errorifexists").text(path)


class Stages:
    """Named stage tables, written as Parquet into a folder of the user's or else the shared one, and how long each took."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder, self.seconds = folder, {}

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """The table, read back from its stage file, or from the shared folder if no stages are kept: later stages read it more than once."""
        with self.timed(name):
            if not self.folder:
                return settled(df, name)
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def line(self) -> str:
        return "STAGE_TIMINGS " + json.dumps({k: round(v, 6) for k, v in self.seconds.items()})
