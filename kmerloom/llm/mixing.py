"""Mixing sources to target weights, by DataFrame functions alone.

The words of each source, in a fixed order of its documents, are packed into fixed-length blocks. A source's part of the mix is a
row of slots, whole passes over its blocks and a last, partial one; each slot draws its output shard, so that the counts of sources
in a shard are multinomial draws, while each source's total is exact. Slot j of a pass maps through the source's
pseudorandom permutation of its full block indices (its shorter last block comes last), and blocks join slots by index.
Sources stay in tables; the driver sees only a few sums over all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dense_names, whole_row

WORD = r"[^\x20\x09-\x0D]+"
#: Slots are made in runs of so many, and runs in rows of so many, so that no row carries more at once.
_RUN = 8192
#: Slots that a task makes, about.
_SLOTS_A_TASK = 250_000
# Primes above any number of blocks, so each is a step that reaches all of them.
_STEPS = (1099511627791, 1099511627803, 1099511627831, 1099511628161, 1099511628391, 1099511628401)


def with_targets(scratch: Scratch, sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(_source, source_size, _k, target) from (_source, source_size): _k counts the sources in code-point order, null last.

    The weights repeat over the sources and share the sum of all sizes; a target stops at most times its
    source's size, and the excess is shared again by weight among the others until none is above. Each round of sharing is one sum
    over the sources.
    """
    keyed = scratch.save(sizes.select(F.col("_source").isNull().alias("_last"), F.coalesce("_source", F.lit("")).alias("_name"), "_source", "source_size"), "sizes")
    ranks = dense_names(scratch, keyed, ["_last", "_name"], "_k", "ranks")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = scratch.save(keyed.join(ranks, ["_last", "_name"]).select("_source", "source_size", F.col("_k").cast("int").alias("_k"), weight.alias("_weight")), "ranked")
    ceiling = most * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    rest, share, free = total, ranked.agg(F.sum("_weight")).first()[0] or 1.0, None
    while True:  # who is above with little to share stays above with more
        above = rest * F.col("_weight") / share > ceiling
        held, left, n = ranked.agg(F.sum(F.when(above, ceiling)), F.sum(F.when(~above, F.col("_weight"))), F.count(F.when(~above, 1))).first()
        if n == free or not left:
            break
        rest, share, free = total - (held or 0.0), left, n
    target = F.least(rest * F.col("_weight") / share, ceiling)
    return ranked.select("_source", "source_size", "_k", target.alias("target"))


def _passes(sources: DataFrame, block: int, most: float, seed: int) -> DataFrame:
    """Adds to sources what their slots need: _full (blocks), _blocks (with the shorter last one), _step and _shift of the permutation, _slots in
    all, and _cut, the words that the last slot takes of its block (null: all)."""
    size = F.col("source_size")
    words = F.least(F.floor(F.col("target") + 0.5), F.floor(size * most)).cast("long")
    rows = sources.withColumn("_words", words).withColumn("_full", F.floor(size / block).cast("long")).withColumn("_blocks", F.ceil(size / block).cast("long"))
    chance = F.xxhash64(F.lit(seed), F.col("_source").isNull(), "_source")
    step = F.element_at(F.array(*map(F.lit, _STEPS)), (F.pmod(chance, F.lit(len(_STEPS))) + 1).cast("int"))
    over = F.when(size > 0, F.col("_words") % size).otherwise(0)
    rounds = F.when(size > 0, F.floor(F.col("_words") / size)).otherwise(0)
    some = F.ceil(over / block)
    return rows.select(
        "_source", "source_size", "_k", "target", "_full", "_blocks", F.pmod(step, F.greatest("_full", F.lit(1))).alias("_step"), F.pmod(F.xxhash64(chance), F.greatest("_full", F.lit(1))).alias("_shift"),
        (rounds * F.col("_blocks") + some).cast("long").alias("_slots"), F.when(over > 0, over - (some - 1) * block).cast("long").alias("_cut"),
    )


def _permuted(slot: Column) -> Column:
    """The block of a pass's slot: full blocks in the order of their source's permutation, then the last."""
    wide = "decimal(38,0)"
    place = (slot.cast("decimal(18,0)") * F.col("_step").cast("decimal(18,0)") + F.col("_shift").cast("decimal(18,0)")).cast(wide) % F.greatest("_full", F.lit(1)).cast(wide)
    return F.when(slot < F.col("_full"), place.cast("long")).otherwise(slot)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = 64, shards: int | None = None, shard_slots: int = 32_768, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17, rows_a_bucket: int = 1_000, whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents has a row per input row: _row, id, _k (its source), size, source_size, target, taken, and with whole
    _all, its columns, in place of source_size and target. pieces has a row per document and taken block part: _row, _round, _from, _upto, _shard, _slot (word
    places in the document). shards: how many there are, by default as many as make shard_slots slots each, about.

    A null text has no words, a null source is a source of its own that comes last, a null id sorts first, repeated
    rows are documents each, and an empty table gives empty results. The order of words within a source is by
    bucket (a hash of id and text) and then id; sums per bucket give each bucket's place, so no source meets in one
    task.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    n_rows = docs.count()
    buckets = max(1, -(-n_rows // max(rows_a_bucket, math.isqrt(n_rows))))  # a bucket and a source's row of buckets both grow as the root at most
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    sized = scratch.save(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            hashed.alias("_hash"),
            F.pmod(hashed, F.lit(buckets)).cast("int").alias("_bucket"),
            *([whole_row(docs)] if whole else []),
        ),
        "sized",
    )
    sums = scratch.save(sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum")), "sums")
    targets = with_targets(scratch, sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, most)
    sources = scratch.save(_passes(targets, block, most, seed), "sources")
    n_slots = sources.agg(F.sum("_slots")).first()[0] or 0
    shards = shards or max(1, -(-n_slots // shard_slots))
    name = sources.select(F.col("_source").alias("_s"), "_k")
    of_source = lambda df: df.join(name, df["_source"].eqNullSafe(name["_s"])).drop("_source", "_s")
    places = (
        of_source(sums)
        .withColumn("_base", F.sum("_sum").over(Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_k", "_bucket", F.coalesce("_base", F.lit(0)).alias("_base"))
    )
    upto = Window.partitionBy("_k", "_bucket").orderBy("_id", "size", "_hash", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        of_source(sized.select("_row", "_id", "_source", "size", "_hash", "_bucket"))
        .withColumn("_end", F.sum("size").over(upto))
        .join(places, ["_k", "_bucket"])
        .withColumn("_at", F.col("_base") + F.col("_end") - F.col("size"))
    )
    run = F.lit(_RUN).cast("long")
    rows = sources.where("_slots > 0").withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1, run * run)))
    rows = rows.withColumn("_lo", F.explode(F.sequence("_lo", F.least(F.col("_lo") + run * run, F.col("_slots")) - 1, run)))
    rows = rows.repartition(max(1, -(-n_slots // _SLOTS_A_TASK)), "_k", "_lo").withColumn("_slot", F.explode(F.sequence("_lo", F.least(F.col("_lo") + run, F.col("_slots")) - 1)))
    slots = rows.select(
        "_k", "_slot", F.floor(F.col("_slot") / F.col("_blocks")).cast("long").alias("_round"), _permuted(F.col("_slot") % F.col("_blocks")).alias("_index"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "_k", "_slot"), F.lit(shards)).cast("int").alias("_shard"), F.when(F.col("_slot") == F.col("_slots") - 1, F.col("_cut")).alias("_cut"),
    )
    parts = placed.where("size > 0").select(
        "_row", "_k", "_at", "size",
        F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))).alias("_index"),
    )
    start = F.greatest(F.col("_at"), F.col("_index") * block)
    end = F.least(F.col("_at") + F.col("size"), F.col("_index") * block + F.coalesce(F.col("_cut"), F.lit(block)))
    pieces = (
        parts.join(slots.hint("merge"), ["_k", "_index"])  # made of a few runs, slots look small to the optimizer
        .select("_row", "_round", "_shard", "_slot", (start - F.col("_at")).alias("_from"), (end - F.col("_at")).alias("_upto"))
        .where("_from < _upto")
    )
    pieces = scratch.save(pieces, "pieces")
    if whole:
        return sized.select("_row", F.col("_id").alias(id_col), "_all", "size"), pieces
    taken = pieces.groupBy("_row").agg(F.sum(F.col("_upto") - F.col("_from")).alias("taken"))
    of = sources.select(F.col("_source").alias("_s"), "_k", "source_size", "target")
    documents = sized.join(of, sized["_source"].eqNullSafe(of["_s"])).select("_row", F.col("_id").alias(id_col), "_k", "size", "source_size", "target")
    return documents.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0))), pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """A row per input row: id, size, source_size, target, taken; see mixed()."""
    documents, _ = mixed(docs, id_col, text_col, source_col, **options)
    return documents.select(id_col, "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row per document and round that takes words of it.

    A round that takes a whole document repeats its text as it stands; a part is its taken words in order,
    joined by spaces. Documents of which nothing is taken go, those without words among them. length_col, where docs has it, is the new
    length. Null ids and sources stay null, repeated rows are documents each, an empty table gives an empty result.
    """
    documents, pieces = mixed(docs, id_col, text_col, source_col, whole=True, **options)
    rounds = pieces.groupBy("_row", "_round").agg(
        F.sum(F.col("_upto") - F.col("_from")).alias("_words"), F.array_sort(F.collect_list(F.struct("_from", "_upto"))).alias("_spans")
    )
    rows = rounds.join(documents.select("_row", "_all", "size"), "_row")
    old = F.col("_all").getField(text_col)
    cut = F.col("_words") != F.col("size")

    def part(words: Column) -> Column:
        spans = F.transform("_spans", lambda s: F.slice(words, (s["_from"] + 1).cast("int"), (s["_upto"] - s["_from"]).cast("int")))
        return F.array_join(F.flatten(spans), " ")

    words = F.regexp_extract_all(old, F.lit(WORD), F.lit(0))
    parts = F.transform(F.array(words), part)  # an array of one, so that a text is cut into words once and not for each span
    rows = rows.select("_all", F.when(cut, F.element_at(parts, 1)).otherwise(old).alias("_new"))
    new = {text_col: F.col("_new")}
    if length_col in docs.columns:
        new[length_col] = F.length("_new").cast(docs.schema[length_col].dataType)
    return rows.select(*(new.get(c, F.col("_all").getField(c)).alias(c) for c in docs.columns))
