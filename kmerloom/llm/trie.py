"""The prefix trie of conversations, by partition refinement.

All conversations start in one class. Turn by turn a class is split by what its members say next; what leaves a class alone is retired,
and its tail becomes a chain of nodes with one child each, without a further round. So there are as many rounds as the longest prefix
that two conversations share has turns, and each touches only the members of classes that are still shared. Then the classes are folded
back from the deepest: children, leaves and savings of a class are sums over those it was split into.

A turn is known by the SHA-256 of its role and text, a class by its smallest member and its depth. What the driver sees is a row per
partition and a count per round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_WORD = r"[^ \t-\r]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def in_order(scratch: Scratch, conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((c, p, t, w) turns by place from 0, digest and words; (c, n) conversations by their number of turns).

    A place is a rank in one sort of all turns, less the rank of the conversation's first; so a conversation of any length spreads over tasks.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    order = [F.asc("c"), F.asc_nulls_first("turn"), F.asc("_role"), F.asc("_text"), F.asc("t"), F.asc("_row")]
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.substring(role, 1, 64).alias("_role"), F.substring(text, 1, 64).alias("_text"),
        digest.alias("t"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("w"), F.monotonically_increasing_id().alias("_row"),
    )
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "t", "w", F.monotonically_increasing_id().alias("_place"))
    placed = scratch.save(placed, "placed")
    part, first, starts = F.shiftright("_place", 33), 0, []
    for k, n in sorted(placed.groupBy(part.alias("k")).count().collect()):  # a row per partition
        starts.append((k, first))
        first += n
    starts = placed.sparkSession.createDataFrame(starts, "_part long, _first long")
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select("c", "t", "w", (F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("_rank"))
    convs = scratch.save(ranked.groupBy("c").agg(F.min("_rank").alias("_begin"), F.count(F.lit(1)).alias("n")), "convs")
    turns = scratch.save(ranked.join(convs.select("c", "_begin"), "c").select("c", (F.col("_rank") - F.col("_begin")).alias("p"), "t", "w"), "turns")
    return turns, convs.select("c", "n")


def rebuilt(scratch: Scratch, turns: DataFrame, convs: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """((c, depth, t, w), (c, length)): every conversation with the first h turns of conversation c - c % every in place of its own first h,
    where h is the crc32 of c in decimals modulo heads; fewer if that one is shorter, none if it is not there."""
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(heads))
    convs = convs.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % every).alias("d"))
    donors = convs.where(F.col("c") == F.col("d")).select("d", F.col("n").alias("_there"))
    got = F.least("h", F.coalesce("_there", F.lit(0))).alias("got")
    convs = scratch.save(convs.join(donors, "d", "left").select("c", "d", "h", got, (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + got).alias("length")), "lengths")
    given = turns.where((F.col("c") % every == 0) & (F.col("p") < heads)).select(F.col("c").alias("d"), "p", "t", "w")
    first = convs.where("h > 0").join(given, "d").where("p < h").select("c", (F.col("p") + 1).alias("depth"), "t", "w")
    own = turns.where(F.col("p") >= h).join(convs.select("c", "h", "got"), "c").select("c", (F.col("got") + F.col("p") - F.col("h") + 1).alias("depth"), "t", "w")
    both = first.unionByName(own).repartitionByRange("depth", "c").sortWithinPartitions("depth", "c")  # so that a round reads its own depth
    return scratch.save(both, "rebuilt"), convs.select("c", "length")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the same node in sorted (conv_id, depth, c), as (conv_id, depth, first c, c's joined by commas)."""
    for batch in batches:
        node, depth, c = (batch.column(k).to_numpy() for k in range(3))
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (depth[1:] != depth[:-1])) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(c)]])
        if len(c):
            texts = [",".join(map(str, c[a:b].tolist())) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(depth[starts]), pa.array(c[starts]), pa.array(texts)], names=["conv_id", "depth", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) of each node's parts, which come in order; no more than a batch is held."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for node, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (node, depth) == key:
                state.update(b",")
            else:
                done += [(*key, state.hexdigest())] if key else []
                key, state = (node, depth), hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["conv_id", "depth", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["conv_id", "depth", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes of members (conv_id, depth, c): the SHA-256 of their c in order, joined by commas.

    Ids become text where a sort of all of them has put them; one task a node then only runs the hash over those parts, as a hash must.
    """
    parts = members.repartitionByRange("conv_id", "depth", "c").sortWithinPartitions("conv_id", "depth", "c").mapInArrow(_joined, "conv_id long, depth long, first long, ids string")
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digested, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20, heads: int = 4,
) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations, as NODE says; the root is the prefix without turns.

    Turns go by turn (null first), those of the same turn by role and text (their first 64 characters, then their digest); repeated
    rows are turns each. Null role or text is empty. Rows without a conversation's id belong to none and are not read. An empty table gives no node, not
    even a root. Other columns are not read. heads = 1 leaves the conversations as they are.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = in_order(scratch, conversations, conv_col, turn_col, role_col, text_col)
    turns, lengths = rebuilt(scratch, turns, convs, every, heads)
    scratch.drop("placed", "turns", "convs")
    n, root = lengths.agg(F.count(F.lit(1)), F.min("c")).first()
    start = lengths.select("c", F.lit(root).cast("long").alias("cls"), "length", F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("depth"))

    def split(step: DataFrame, parent: Column) -> DataFrame:
        found = step.groupBy("depth", "cls", "t").agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max("length").alias("length"))
        return found.select("conv_id", "depth", parent.alias("parent"), "cls", "t", "n", "w", "length")

    def members(step: DataFrame, groups: DataFrame) -> DataFrame:
        """(c, conv_id, depth, length) of what is still in a class with others."""
        shared = groups.where("n > 1").select("depth", "cls", F.col("t").alias("_t"), "conv_id")
        return step.join(shared, (step["depth"] == shared["depth"]) & (step["cls"] == shared["cls"]) & step["t"].eqNullSafe(shared["_t"])).select("c", "conv_id", step["depth"], "length")

    step = scratch.save(start, "step0")
    groups = scratch.save(split(step, F.lit(None).cast("long")), "groups0")
    depth = 0
    while n and groups.where("n > 1").head(1):
        depth += 1
        active = members(step, groups).where(F.col("length") >= depth).select("c", F.col("conv_id").alias("cls"), "length")
        step = scratch.save(active.join(turns.where(F.col("depth") == depth), "c").select("c", "cls", "length", "t", "w", "depth"), f"step{depth}")
        groups = scratch.save(split(step, F.col("cls")), f"groups{depth}")
    level = range(depth + 1)
    steps, groups = (scratch.read(*(f"{x}{k}" for k in level)) for x in ("step", "groups"))
    digests = scratch.save(ends(members(steps.where("depth = length"), groups).select("conv_id", "depth", "c")), "digests")

    below = None
    for k in reversed(level[:-1] if depth else level):  # the last round left nothing shared
        own = scratch.read(f"groups{k}").where("n > 1")
        kids = scratch.read(f"groups{k + 1}").where("n = 1").select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")) if k < depth else None
        if below is not None:
            kids = kids.unionByName(below.select("parent", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        if kids is None:
            kids = own.where("false").select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        kids = kids.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        folded = own.join(kids, "conv_id", "left").select(
            "conv_id", "depth", "parent", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n") - 1) * F.col("w")).alias("saved_tokens"),
        )
        below = scratch.save(folded, f"folded{k}")
    shared = scratch.read(*(f"folded{k}" for k in (level[:-1] if depth else level)))
    scratch.drop(*(f"step{k}" for k in level), "rebuilt", "lengths")

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    alone = groups.where("n = 1").withColumn("at", F.explode(F.sequence("depth", "length")))
    chains = alone.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("at") < F.col("length"), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("at") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    classes = shared.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
    return classes.unionByName(chains)
