"""Exact dedup by deterministic block naming.

Each text, without its white space, is cut into fixed-size blocks. The distinct blocks are sorted and
named by integers; then adjacent names are paired and the distinct pairs sorted and named again, level by
level, until one name is left per document. Two documents are equal exactly if they end at the same level
with the same name: names are ranks of distinct contents, so nothing rests on a hash being free of collisions.

Block contents cross the network once, for the distinct sort. A block travels on as its 64-bit hash, but
only after a count of the distinct contents behind each hash has shown that there is one; contents behind a
shared hash are named by themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE, Scratch, dense_names, whole_row

#: Stands for the missing right neighbour of a last, odd block; no name is negative that far.
_NO_RIGHT = -(1 << 62)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256, level, name.

    Texts are equal if they are after every white-space character is deleted; a null text is the empty text.
    Of a group the row with the most code points stays, then the smallest id (a null id comes last), then the
    first of rows that are the same in all of that; so exactly one row of each group has kept = true, also
    among repeated rows. An empty table gives an empty result. Other columns of docs are not read.
    hash_of is a parameter for tests of colliding hashes.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_blocks = F.greatest(F.ceil(F.octet_length("_bytes") / block_bytes), F.lit(1)).cast("int")

    def block(i: Column) -> Column:
        return F.substring(F.col("_bytes"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes))

    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.length(text).alias("_length"),
        F.translate(text, WHITESPACE, "").cast("binary").alias("_bytes"),
    )
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), block)

    def heads(rows: DataFrame, table: str) -> DataFrame:
        return scratch.save(rows.select("_row", "_id", "_length", F.sha2("_bytes", 256).alias("_sha"), F.transform(cut, lambda b: hash_of(b)).alias("_hashes")), table)

    head = heads(base, "head")
    contents = base.select(F.explode(cut).alias("_block")).select(hash_of(F.col("_block")).alias("_hash"), "_block").distinct()
    hashes = scratch.save(contents.groupBy("_hash").agg(F.count(F.lit(1)).alias("_contents")), "hashes")
    shared = hashes.where("_contents > 1").select("_hash")
    names = dense_names(scratch, hashes, ["_hash"], "_name", "names0")
    if clash := bool(shared.head(1)):  # their contents are needed again, under the same row numbers
        base = scratch.save(base, "base")
        head = heads(base, "head2")
    items = head.select("_row", F.size("_hashes").alias("_left"), F.posexplode("_hashes").alias("_pos", "_hash"))
    named = items.join(names, "_hash").select("_row", "_left", "_pos", "_name")
    if clash:  # blocks with different contents behind one hash: named by content, below zero
        ranks = dense_names(scratch, contents.join(shared, "_hash", "left_semi"), ["_hash", "_block"], "_rank", "shared")
        own = base.select("_row", F.posexplode(cut).alias("_pos", "_block")).withColumn("_hash", hash_of(F.col("_block"))).join(ranks, ["_hash", "_block"])
        named = (
            named.join(own.select("_row", "_pos", "_rank"), ["_row", "_pos"], "left")
            .withColumn("_name", F.coalesce(-1 - F.col("_rank"), F.col("_name")))
            .drop("_rank")
        )
    longest = head.agg(F.max(F.size("_hashes"))).first()[0] or 1
    level = scratch.save(named, "level0")
    done = [level.where("_left = 1").select("_row", F.lit(0).alias("_level"), "_name")]
    for k in range(1, (longest - 1).bit_length() + 1):
        left, right = (F.max(F.when(F.col("_pos") % 2 == side, F.col("_name"))) for side in (0, 1))
        pairs = (
            level.where("_left > 1")
            .groupBy("_row", F.ceil(F.col("_left") / 2).cast("int").alias("_left"), F.floor(F.col("_pos") / 2).cast("int").alias("_pos"))
            .agg(left.alias("_l"), F.coalesce(right, F.lit(_NO_RIGHT)).alias("_r"))
        )
        names = dense_names(scratch, pairs, ["_l", "_r"], "_name", f"names{k}")
        level = scratch.save(pairs.join(names, ["_l", "_r"]).select("_row", "_left", "_pos", "_name"), f"level{k}")
        done.append(level.where("_left = 1").select("_row", F.lit(k).alias("_level"), "_name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    rows = scratch.save(head.drop("_hashes").join(identity, "_row"), "rows")
    scratch.drop("head", *(f"{x}{k}" for k in range((longest - 1).bit_length() + 1) for x in ("names", "level")))
    best = F.min(F.struct((-F.col("_length")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = rows.groupBy("_level", "_name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
    groups = scratch.save(groups, "groups")  # so that the join below has the rows of a large group dealt over several tasks
    return rows.join(groups, ["_level", "_name"]).select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        F.col("_level").alias("level"),
        F.col("_name").alias("name"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows are found again by id, text and length; where rows agree in all of these, one of them stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = exact_dedup(docs, id_col, text_col)
    found = found.select(F.col(id_col).alias("_i"), F.col("text_sha256").alias("_s"), "kept")
    best = found.where("kept").select(F.col("_i").alias("_id"), F.col("_s").alias("_sha"))
    kept = found.join(best, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha"))).groupBy("_id", "_sha").agg(F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(whole_row(docs), F.col(id_col).alias("_i"), F.sha2(F.translate(text, WHITESPACE, "").cast("binary"), 256).alias("_s"), F.length(text).alias("_n"), F.xxhash64(text).alias("_h"))
    rows = rows.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")))
    first = Window.partitionBy("_id", "_sha").orderBy(F.desc("_n"), "_h")
    several = rows.where("_rows > 1").withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return rows.where("_rows = 1").select("_all.*").unionByName(several.select("_all.*"))
