"""The evaluation of distances: result tables reshaped, filtered, grouped and scored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns, the order in which tools are shown, tools that are shown by their plain name (as it is written), and the
# endings that names lose.
TIMES = "Tool string, Threads int, `K-mer` string, Scale double, Sketch double, Runtime double, Memory bigint"
TREES = "Tool string, Taxon string, K int, RF double, nRF double"
TREE_OPTIONS = "Scale double, Sketch double"
ACCURACY_KEYS = ("Genome", "k", "Tool", "C_rate", "Mode")
RUN_COLUMNS = ("Tool", "Threads", "K-mer", "SketchSize", "Elapsed_Time(s)", "MaxResident_Memory(KB)")
TOOL_ORDER = ("fastani", "skani", "mash")
PLAIN_TOOLS = {"fastani": "FastANI", "mash": "Mash"}
NAME_ENDINGS = (".sketch", ".msh", ".fa", ".fasta")
#: Distances from here on are taken as not measured.
CENSORED_FROM = 0.3


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """A timing table from CSV with a header; nan and - are missing."""
    rows = spark.read.csv(path, header=True, nullValue="nan", schema=TIMES, enforceSchema=True)
    return rows.withColumn("K-mer", F.when(F.col("K-mer") != "-", F.col("K-mer")))


def _number(col: str) -> Column:
    """A column of numbers; what is none is missing, nan among it."""
    value = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    return F.when(~F.isnan(value), value).alias(col)


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """An accuracy table from CSV: Genome, k, Tool, C_rate, Mode, and a Time_N= and an ERR_d= column for each number and distance; values that are no
    numbers (- or nan) are missing. A dot in a column's name becomes _, as melt() takes it."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    text = {"Genome", "Tool", "Mode"}
    rows = rows.select(*(F.col(f"`{c}`") if c in text else _number(c) for c in rows.columns))
    return rows.toDF(*(c.replace(".", "_") for c in rows.columns))


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """A table of tree distances from CSV: Tool, Taxon, K, RF, nRF, and Scale and Sketch, which are missing where the file has none."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))
    rows = rows.select(*(F.col(c) if c in ("Tool", "Taxon") else _number(c).cast("int").alias(c) if c == "K" else _number(c) for c in rows.columns))
    return rows.select(*(rows[c] if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("Tool", "Taxon", "K", "RF", "nRF", "Scale", "Sketch")))


def accuracy_table(rows: DataFrame, times: Sequence[int], distances: Sequence[float]) -> DataFrame:
    """The rows of read_accuracy's table, as text to write: Genome, k, Tool, C_rate, Mode, then a time for each number (columns t1, t2, ...) and an
    error for each distance (columns e1, e2, ...); a missing k is -, a missing number nan."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "nan").otherwise(F.col(c).cast("string"))
    heads = [F.coalesce(F.col("k").cast("string"), F.lit("-")).alias("k") if c == "k" else F.col(c).cast("string").alias(c) for c in ACCURACY_KEYS]
    columns = [number(f"t{k}").alias(f"Time_N={n}") for k, n in enumerate(times, 1)] + [number(f"e{k}").alias(f"ERR_d={d:.3f}") for k, d in enumerate(distances, 1)]
    return rows.select(*heads, *columns)


def tree_table(rows: DataFrame) -> DataFrame:
    """Tool (in lower case), Taxon, K, RF, nRF as text to write; a missing distance is NaN."""
    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "NaN").otherwise(F.col(c).cast("string")).alias(c)
    return rows.select(F.lower("Tool").alias("Tool"), "Taxon", F.col("K").cast("string").alias("K"), number("RF"), number("nRF"))


def run_table(rows: DataFrame) -> DataFrame:
    """Tool (in lower case), threads, k, size, seconds and kilobytes (columns in this order) as the table of single runs; a missing k or size is -."""
    tool, threads, k, size, seconds, memory = rows.columns
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))
    return rows.select(F.lower(F.col(f"`{tool}`")), text(threads), text(k), text(size), F.format_string("%.2f", F.col(f"`{seconds}`").cast("double")), text(memory)).toDF(*RUN_COLUMNS)


def write_table(table: DataFrame, path: str, files: int = 1) -> None:
    """A table as CSV with a header in each of so many files; result tables are small, and one file is what other tools read."""
    table.coalesce(files).write.mode("overwrite").csv(path, header=True, emptyValue="")


def name_stem(path: Column, endings: Sequence[str] = NAME_ENDINGS) -> Column:
    """The last part of a path without each of the endings, taken off in that order, each at most once."""
    out = F.element_at(F.split(path, "/"), -1)
    for ending in endings:
        out = F.when(F.endswith(out, F.lit(ending)), F.substring(out, F.lit(1), F.length(out) - len(ending))).otherwise(out)
    return out


def file_length(content: Column) -> Column:
    """The bases of a sequence file's text as its length is taken here: of every line but the first, what is left without white space at its ends
    (later headers count as bases)."""
    trimmed = F.transform(F.slice(F.split(content, "\n", -1), 2, 1 << 30), lambda line: F.length(F.regexp_replace(line, r"^[ \t-\r]+|[ \t-\r]+$", "")))
    return F.aggregate(trimmed, F.lit(0).cast("long"), lambda n, x: n + x)


def short_stem(path: Column) -> Column:
    """The last part of a path up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def melt(wide: DataFrame, ids: Sequence[str], prefix: str = "ERR_d=", value: str = "Err") -> DataFrame:
    """A row per id row and column that starts with prefix: d_col, value, and d, the number in the column's name."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(*ids, *columns).unpivot(list(ids), columns, "d_col", value)
    return long.withColumn("d", F.regexp_extract("d_col", r"[0-9.]+$", 0).cast("double"))


def row_mean(columns: Sequence[str]) -> Column:
    """The mean of a row's columns, missing ones left out; null if all are."""
    present = [F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c)) for c in columns]
    n = sum((p.isNotNull().cast("int") for p in present), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(p, F.lit(0.0)) for p in present), F.lit(0.0)) / n)


def label(tool: Column, k: Column, plain: Mapping[str, str] = PLAIN_TOOLS) -> Column:
    """A tool's label: a plain tool's one spelling, whatever the case it is given in and whatever k; else its name, with k in brackets unless that is
    missing. plain: lower-case names and how they are written."""
    bare = F.trim(F.coalesce(tool, F.lit("Unknown")))
    out = F.when(k.isNull(), bare).otherwise(F.concat(bare, F.lit(" (k="), k.cast("int").cast("string"), F.lit(")")))
    for low, written in plain.items():
        out = F.when(F.lower(bare) == low, F.lit(written)).otherwise(out)
    return out


def sort_keys(label_col: Column, order: Sequence[str] = TOOL_ORDER) -> list[Column]:
    """Sort keys of labels: the tool's place (others last), k, then the label in lower case."""
    low = F.lower(label_col)
    place = F.lit(len(order) + 1)
    for k, tool in reversed(list(enumerate(order, 1))):
        place = F.when(F.contains(low, F.lit(tool)), k).otherwise(place)
    return [place, F.coalesce(F.try_to_number(F.regexp_extract(label_col, r"k=([0-9]+)", 1), F.lit("999999")), F.lit(0)).cast("int"), low]


def derived(times: DataFrame) -> DataFrame:
    """Timing rows with gigabytes, 1/Scale, and k with N/A for missing ones."""
    return times.select(
        "*", (F.col("Memory") / (1024 * 1024)).alias("memory_GB"), F.when(F.col("Scale") != 0, 1 / F.col("Scale")).alias("ReverseScale"), F.coalesce("K-mer", F.lit("N/A")).alias("k_label")
    )


def ani_symm(directed: DataFrame, a: str = "a", b: str = "b", ani: str = "ani", names: DataFrame | None = None) -> DataFrame:
    """(a, b, dist) from directed identities in percent, in both directions of every pair that has one: 1 - the mean identity of both directions, or
    that of the one there is; and 0 for each name with itself, those in names (name) among them."""
    one = directed.select(F.col(a).alias("a"), F.col(b).alias("b"), F.least(F.greatest(F.col(ani) / 100, F.lit(0.0)), F.lit(1.0)).alias("v"))
    other = one.where("a != b")
    turned = F.explode(F.array(F.struct("a", "b", "v"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "v")))
    both = other.select(turned.alias("x")).select("x.*").groupBy("a", "b").agg(F.greatest(F.lit(0.0), 1 - F.avg("v")).alias("dist"))
    every = one.select(F.explode(F.array("a", "b")).alias("a"))
    if names is not None:
        every = every.union(names.select("name"))
    return both.unionByName(every.distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("dist")))


def symmetric_closure(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, dist) in both orders; where only one order is there, the other is filled in from it."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")
    return pairs.unionByName(back.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))


def score_accuracy(expected: DataFrame, predicted: DataFrame, censored_from: float = CENSORED_FROM) -> DataFrame:
    """(name, true_d, error): |true - predicted| of the pair ("ref", name) in either order; null where there is none below censored_from."""
    measured = predicted.select("a", "b", F.when(F.col("distance") < censored_from, F.col("distance")).alias("p"))
    to_ref = measured.where(F.col("a") == "ref").select(F.col("b").alias("name"), "p").unionByName(measured.where((F.col("b") == "ref") & (F.col("a") != "ref")).select(F.col("a").alias("name"), "p"))
    one = to_ref.groupBy("name").agg(F.max("p").alias("p"))
    return expected.join(one, "name", "left").select("name", "true_d", F.abs(F.col("true_d") - F.col("p")).alias("error"))


def clade_subset(clades: DataFrame, available: DataFrame, least: int = 3) -> DataFrame:
    """(clade, taxa): each clade's taxa (an array) that are available (name), sorted; clades with fewer than least go."""
    each = clades.select("clade", F.explode("taxa").alias("name")).join(available.select("name").distinct(), "name", "left_semi")
    return each.groupBy("clade").agg(F.array_sort(F.collect_set("name")).alias("taxa")).where(F.size("taxa") >= least)


def build_ref(records: DataFrame, group: str, order: str, seq_col: str = "seq") -> DataFrame:
    """(group, seq): each group's sequences in upper case, joined in order."""
    rows = records.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.upper(seq_col).alias("s")))).alias("p"))
    return rows.select(group, F.array_join(F.col("p.s"), "").alias("seq"))


def bands(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation of value by groups, with the number of rows."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
