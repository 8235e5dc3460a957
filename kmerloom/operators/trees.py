"""Tree comparison by hashed bipartitions: trees become rows of splits, and the Robinson-Foulds distances of many pairs are one join.

A split is what an inner edge does to the taxa. Every taxon has a 128-bit hash, a side's is the xor of its taxa's, and a split is known by the lesser of
its two sides; so a rooted tree gives the splits of the unrooted one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s+|\[[^\]]*\]|(?P<mark>[(),:;])|'(?P<quoted>(?:[^']|'')*)'|(?P<plain>[^\s()\[\],:;']+)")


class BadTree(ValueError):
    """A text that is no Newick tree."""


def splits_of(newick: str) -> tuple[int, int, list[int]]:
    """(number of taxa, xor of their hashes, distinct splits in order) of a Newick tree up to its ;. Lengths, comments and names of inner nodes are passed over."""
    open_nodes: list[list[int]] = []  # (xor, taxa) of what is under each node that is still open
    sides: list[list[int]] = []
    taxa: set[str] = set()
    at, before, ended = 0, "(", False
    for m in _TOKEN.finditer(newick):
        if m.start() != at:  # something that is no token
            break
        at, mark = m.end(), m["mark"]
        name = m["plain"] if m["plain"] is not None else m["quoted"] and m["quoted"].replace("''", "'")
        if ended and (mark or name is not None):
            raise BadTree("something after the ;")
        if mark and mark != "(" and before in "(,":
            raise BadTree(f"a {mark} after a {before}")
        if mark == "(":
            if before not in "(,":
                raise BadTree("a ( after a subtree")
            open_nodes.append([0, 0])
        elif mark == ")":
            if not open_nodes:
                raise BadTree("a ) without a (")
            under = open_nodes.pop()
            sides.append(under)
            if open_nodes:
                open_nodes[-1][0] ^= under[0]
                open_nodes[-1][1] += under[1]
        elif mark == ";":
            ended = True
        elif name is not None and before in "(,":
            if name in taxa or not open_nodes:
                raise BadTree(f"{name} is there twice" if open_nodes else "a name outside of a tree")
            taxa.add(name)
            open_nodes[-1][0] ^= xxhash.xxh3_128_intdigest(name)
            open_nodes[-1][1] += 1
            mark = "name"
        before = mark or before
    if at < len(newick) or open_nodes or not sides or not ended:
        raise BadTree(f"no tree from place {at} on")
    whole, n = sides[-1]
    return n, whole, sorted({min(h, whole ^ h) for h, under in sides[:-1] if 2 <= under <= n - 2})


def splits(trees: DataFrame, id_col: str = "tree", newick_col: str = "newick") -> tuple[DataFrame, DataFrame]:
    """((id, high, low) splits, (id, n_taxa, n_splits, taxa_high, taxa_low) trees) of trees in Newick; a text that is none is an error, a null one has no row."""
    kind = trees.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def limbs(values: list[int]) -> list[pa.Array]:
            return [pa.array([(v >> s & (1 << 64) - 1) - (v >> s + 63 & 1) * (1 << 64) for v in values], pa.int64()) for s in (64, 0)]

        for batch in batches:
            found = [splits_of(x.as_py()) for x in batch.column(1)]
            ids = batch.column(0).take(pa.array([k for k, (_, _, own) in enumerate(found) for _ in range(len(own) + 1)], pa.int64()))
            rows = [(v, i) for n, whole, own in found for v, i in [(whole, n), *((h, None) for h in own)]]
            count = [x for n, _, own in found for x in [len(own), *[None] * len(own)]]
            yield pa.RecordBatch.from_arrays([ids, *limbs([v for v, _ in rows]), pa.array([n for _, n in rows], pa.int64()), pa.array(count, pa.int64())], names=["tree", "high", "low", "n_taxa", "n_splits"])

    rows = trees.select(id_col, newick_col).where(F.col(newick_col).isNotNull()).mapInArrow(run, f"tree {kind}, high long, low long, n_taxa long, n_splits long")
    whole = rows.where("n_taxa is not null").select("tree", "n_taxa", "n_splits", F.col("high").alias("taxa_high"), F.col("low").alias("taxa_low"))
    return rows.where("n_taxa is null").select("tree", "high", "low"), whole


def robinson_foulds(trees: DataFrame, pairs: DataFrame, id_col: str = "tree", newick_col: str = "newick") -> DataFrame:
    """(a, b, rf, nrf, n_taxa) for pairs (a, b) of trees: how many splits one has and the other has not, and that over 2 (n - 3).

    rf is null where the trees differ in their taxa, nrf also below four taxa; a pair with an unknown tree has no row. Repeated pairs are answered each.
    """
    found, whole = splits(trees, id_col, newick_col)
    pairs = pairs.select("a", "b")
    ends = [whole.select(F.col("tree").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n_taxa", "n_splits", "taxa_high", "taxa_low"))) for x in "ab"]
    one = found.select(F.col("tree").alias("a"), "high", "low")
    other = found.select(F.col("tree").alias("b"), "high", "low")
    shared = pairs.distinct().join(one, "a").join(other, ["b", "high", "low"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    same = (F.col("n_taxa_a") == F.col("n_taxa_b")) & (F.col("taxa_high_a") == F.col("taxa_high_b")) & (F.col("taxa_low_a") == F.col("taxa_low_b"))
    rf = F.when(same, F.col("n_splits_a") + F.col("n_splits_b") - 2 * F.coalesce("shared", F.lit(0)))
    rows = pairs.join(ends[0], "a").join(ends[1], "b").join(shared, ["a", "b"], "left").select("a", "b", rf.alias("rf"), F.col("n_taxa_a").alias("n_taxa"))
    return rows.select("a", "b", "rf", F.when(F.col("n_taxa") > 3, F.col("rf") / (2 * (F.col("n_taxa") - 3))).alias("nrf"), "n_taxa")
