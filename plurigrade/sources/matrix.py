"""Readers of text tables: expression matrices, lists, pairs, manifests and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurigrade.functions.scalars import parsed_number

RESULT = ("score", "potency", "relative", "preknn_score", "preknn_potency")


def failing(condition: Column, message: Column) -> Column:
    """True, or an error where the condition holds."""
    return F.when(condition, F.raise_error(message)).otherwise(F.lit(True))


def parsed_rows(lines: DataFrame, cells: int) -> DataFrame:
    """``feature, cell_idx, value`` of body lines (column ``value``): a name and ``cells`` numbers, tab-separated.

    A line with another number of fields, or with a field that is no number, fails the read.  Zeros are kept.
    """
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    split = lines.where(F.col("value") != "").select(F.get(fields, F.lit(0)).alias("feature"), F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))).alias("tokens"))
    numbers = F.transform("tokens", parsed_number)
    checked = split.select("feature", "tokens", numbers.alias("numbers")).where(
        failing(F.size("tokens") != cells, F.concat(F.lit("row "), F.col("feature"), F.lit(f" does not have {cells} fields")))
        & failing(F.exists("numbers", lambda x: x.isNull()), F.concat(F.lit("row "), F.col("feature"), F.lit(" has a field that is no number")))
    )
    return checked.select("feature", F.posexplode("numbers").alias("cell_idx", "value"))


def duplicates(names: DataFrame, column: str) -> DataFrame:
    """``name, n``: the names that stand more than once."""
    return names.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def _header(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The first line, one entry per cell, and the cell names in it."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    names = header[0].rstrip("\r").split("\t")
    if len(set(names)) != len(names):
        raise ValueError(f"{path}: a cell name stands twice")
    return header[0], names


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``cell_idx, cell_id`` of all cells of a text table, in their order."""
    return spark.createDataFrame(list(enumerate(_header(spark, path)[1])), "cell_idx int, cell_id string")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``cell_idx, cell_id, feature, value``, zeros left out, of a genes-by-cells text table.

    The header holds the cell names only.  Repeated cell or feature names fail the read.
    """
    header, names = _header(spark, path)
    cells = spark.createDataFrame(list(enumerate(names)), "cell_idx int, cell_id string")
    body = parsed_rows(spark.read.text(path).where(F.col("value") != header), len(names))
    if not (again := duplicates(body.where("cell_idx = 0"), "feature")).isEmpty():
        raise ValueError(f"{path}: feature {again.first()[0]!r} stands twice")
    return body.where("value <> 0").join(F.broadcast(cells) if len(names) <= 1_000_000 else cells, "cell_idx").select("cell_idx", "cell_id", "feature", "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines that are not empty."""
    return spark.read.text(path).where(F.col("value") != "")


def read_pairs(spark: SparkSession, path: str, key: str = "alias", value: str = "target") -> DataFrame:
    """Two columns of a tab-separated table without header, one row per key: the last one in the file."""
    # Rising numbers follow the order of lines in the file, whatever its splits.
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    pairs = rows.where(F.instr("line", "\t") > 0).select("at", F.split_part("line", F.lit("\t"), F.lit(1)).alias(key), F.split_part("line", F.lit("\t"), F.lit(2)).alias(value))
    return pairs.groupBy(key).agg(F.max_by(value, "at").alias(value))


def model_order(manifest: DataFrame, column: str = "value") -> DataFrame:
    """``position, model``: the array ``model_order`` of a JSON manifest."""
    listed = F.from_json(F.get_json_object(F.col(column), "$.model_order"), "array<string>")
    return manifest.select(F.posexplode(listed).alias("position", "model"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table: ``cell_id``, its five columns and ``row``, which rises with the lines; wrong headers, widths, ids or numbers fail the read."""
    lines = spark.read.text(path)
    header = lines.first()
    if header is None or len(header[0].rstrip("\r").split("\t")) != 6:
        raise ValueError(f"{path}: the header does not have six fields")
    # Rising numbers follow the order of lines in the file, whatever its splits.
    fields = lines.select(F.monotonically_increasing_id().alias("row"), F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    number = lambda i: parsed_number(F.nullif(F.lower(F.trim(F.get("f", F.lit(i)))), F.lit("nan")))
    text = lambda i: F.trim(F.get("f", F.lit(i)))
    bad = lambda i: (text(i) != "") & (F.lower(text(i)) != "nan") & (number(i).isNull() | F.isnan(number(i)) | (F.abs(number(i)) == float("inf")))
    body = fields.where("row > 0").withColumn("copies", F.count("*").over(Window.partitionBy(F.get("f", F.lit(0)))))
    checked = body.where(
        failing(F.size("f") != 6, F.concat(F.lit("line "), F.col("row").cast("string"), F.lit(": not six fields")))
        & failing((F.get("f", F.lit(0)) == "") | (F.col("copies") > 1), F.concat(F.lit("line "), F.col("row").cast("string"), F.lit(": empty or repeated cell id")))
        & failing(bad(1) | bad(3) | bad(4), F.concat(F.lit("line "), F.col("row").cast("string"), F.lit(": a number is not valid")))
    )
    return checked.select("row", F.get("f", F.lit(0)).alias("cell_id"), number(1).alias(RESULT[0]), F.nullif(F.get("f", F.lit(2)), F.lit("")).alias(RESULT[1]), number(3).alias(RESULT[2]), number(4).alias(RESULT[3]), F.nullif(F.get("f", F.lit(5)), F.lit("")).alias(RESULT[4]))
