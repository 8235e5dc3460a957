"""Text reports as DataFrames of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distance import grid


def dist_report(pairs: DataFrame) -> DataFrame:
    """(i, j, report): the block of text of each compared pair (reference, query, shared, total, jaccard, distance)."""
    line = "-" * 50
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Reference File : "), F.col("reference")), F.concat(F.lit("Query File     : "), F.col("query")),
        F.format_string("Shared Hashes  : %d / %d", "shared", "total"), F.lit(line),
        F.format_string("Jaccard Index  : %f", "jaccard"), F.format_string("Distance       : %f", "distance"),
    )
    return pairs.select("i", "j", text.alias("report"))


def triangle_text(triangle: DataFrame, meta: DataFrame) -> DataFrame:
    """(line_no, line): the number of names, then each name with its distances to the earlier ones."""
    rows = triangle.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "distance"))).alias("d"))
    cells = F.transform(F.coalesce("d", F.array().cast("array<struct<j:int,distance:double>>")), lambda x: F.format_string("%f", x["distance"]))
    name = F.coalesce(F.col("name").cast("string"), F.lit("N/A"))
    lines = meta.select(F.col("idx").alias("i"), name.alias("name")).join(rows, "i", "left")
    lines = lines.select(F.col("i").cast("long").alias("line_no"), F.array_join(F.concat(F.array("name"), cells), "\t").alias("line"))
    first = meta.agg(F.lit(-1).cast("long").alias("line_no"), F.count(F.lit(1)).cast("string").alias("line"))
    return first.unionByName(lines)


def matrix_symm(triangle: DataFrame) -> DataFrame:
    """(a, b, distance) in both orders."""
    one = triangle.select("a", "b", "distance")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))


def phylip_text(names: DataFrame, matrix: DataFrame) -> DataFrame:
    """(line_no, line): the square matrix for tree builders; names is (idx, name), matrix (a, b, distance), gaps are nan."""
    cells = grid(names.select(F.col("idx").alias("i"), F.col("name").alias("a")), names.select(F.col("idx").alias("j"), F.col("name").alias("b")), "i", "j", names.count())
    cell = F.when(F.col("i") == F.col("j"), "0.000000").otherwise(F.coalesce(F.format_string("%.6f", "distance"), F.lit("nan")))
    cell = F.when((F.col("i") != F.col("j")) & F.col("distance").isNull(), "nan").otherwise(cell)
    rows = cells.join(matrix, ["a", "b"], "left").groupBy("i", "a").agg(F.array_sort(F.collect_list(F.struct("j", cell.alias("c")))).alias("d"))
    lines = rows.select(F.col("i").cast("long").alias("line_no"), F.concat(F.col("a").cast("string"), F.lit(" "), F.array_join(F.transform("d", lambda x: x["c"]), " ")).alias("line"))
    first = names.agg(F.lit(-1).cast("long").alias("line_no"), F.count(F.lit(1)).cast("string").alias("line"))
    return first.unionByName(lines)


def info(meta: DataFrame) -> DataFrame:
    """(name, k, size) of each sketch."""
    return meta.select(F.coalesce(F.col("name").cast("string"), F.lit("N/A")).alias("name"), "k", F.col("n").alias("size"))
