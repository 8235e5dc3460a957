"""What every sketch's links come to: a row per name instead of a row per pair.

A pair is a link if both have the same k and share a hash. Names with the same sketch are a class and meet the others once, with their number. Classes
are dealt to blocks, each a row of a table, and the product of that table with itself reads them as pairs, so that no block is written more than once. A task sums up its pairs in strips of
bounded size and no pair leaves it, so disk grows with the sketches and only the time with the number of links. All of them are counted and measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .sketch import Sketches, by_name

MOMENTS = ("inter", "uni", "sum_su", "sum_su2", "sum_si", "sum_si2")
#: These are added up in millionths, so that sums do not depend on the order of tasks.
SHARES = ("jaccard", "naive", "homoplasy", "distance")
MILLION = 1_000_000
#: Classes and shared hashes of a block, and entries of a strip. Every class goes to as many tasks as there are blocks, so blocks are as large as a worker's memory allows.
_CLASSES, _ROWS, _STRIP = 1 << 18, 1 << 21, 1 << 18
_S_BITS = 11  # the largest simplicity is 42 * 42


def measured_arrays(m: dict[str, np.ndarray], k: np.ndarray, jukes_cantor: bool) -> dict[str, np.ndarray]:
    """SHARES of MOMENTS with inter > 0, as functions.formula has them."""
    inter, uni, su, su2, si, si2 = (m[c] for c in MOMENTS)
    k2 = (k * k).astype(np.float64)
    j = inter / uni
    naive = 1 - np.power(2 * j / (1 + j), 1 / k)
    mean_u, mean_i = su / k2 / uni, si / k2 / inter
    var_u = np.maximum(su2 / (k2 * k2) / uni - mean_u * mean_u, 0.0)
    var_i = np.maximum(si2 / (k2 * k2) / inter - mean_i * mean_i, 0.0)
    gap2 = (mean_i - mean_u) * (mean_i - mean_u)
    b = var_i - var_u + gap2
    root = np.sqrt(np.maximum(b * b + 4 * var_u * gap2, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(b > 0, 2 * gap2 / (b + root), (root - b) / (2 * var_u))
    simpler = (si * uni > su * inter) & (var_u > 1e-12)
    x = np.where(simpler, np.minimum(np.maximum(x, 0.0), 0.999999), 0.0)
    d = naive - np.log(1 - x) / k
    if jukes_cantor:
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(d >= 0.75, 1.0, -0.75 * np.log(1 - 4 * d / 3))
    return {"jaccard": j, "naive": naive, "homoplasy": x, "distance": np.minimum(np.maximum(d, 0.0), 1.0)}


class _Block:
    """The classes of one block: idx, k, m (names), n, sum_s, sum_s2, and their shared hashes with simplicities, by class or by hash."""

    def __init__(self, t: pa.Table) -> None:
        self.idx, self.k, self.m, self.n, self.s, self.s2 = (t.column(c).to_numpy() for c in ("idx", "k", "m", "n", "sum_s", "sum_s2"))
        self.sizes = pc.list_value_length(t.column("hashes")).to_numpy().astype(np.int64)
        self.hash, self.of_hash = (pc.list_flatten(t.column(c)).to_numpy().astype(np.int64) for c in ("hashes", "simplicities"))
        self.owner = np.repeat(np.arange(len(self.idx)), self.sizes)


class _Sums:
    """Links, sums, least and largest of the figures of each class of a block."""

    def __init__(self, block: _Block, figures: Sequence[str]) -> None:
        n = len(block.idx)
        self.idx, self.figures, self.links = block.idx, figures, np.zeros(n, np.int64)
        self.sum = {f: np.zeros(n, np.int64) for f in figures}
        self.low = {f: np.full(n, np.iinfo(np.int64).max) for f in figures}
        self.high = {f: np.full(n, np.iinfo(np.int64).min) for f in figures}

    def add(self, at: np.ndarray, times: np.ndarray, values: dict[str, np.ndarray]) -> None:
        np.add.at(self.links, at, times)
        for f in self.figures:
            np.add.at(self.sum[f], at, values[f] * times)
            np.minimum.at(self.low[f], at, values[f])
            np.maximum.at(self.high[f], at, values[f])

    def rows(self) -> pa.Table:
        some = self.links > 0
        columns = {"idx": self.idx[some], "n_links": self.links[some]}
        for f in self.figures:
            columns |= {f"{f}_sum": self.sum[f][some], f"{f}_low": self.low[f][some], f"{f}_high": self.high[f][some]}
        return pa.table(columns)


def _met(a: _Block, b: _Block, same: bool):
    """(a, b, inter, low, low2, high, high2) of the classes that share a hash, in strips of a's classes; of one block, each pair once (a > b)."""
    order = np.argsort(b.hash, kind="stable")
    hash_b, owner_b, s_b = b.hash[order], b.owner[order], b.of_hash[order]
    left = np.searchsorted(hash_b, a.hash, "left")
    counts = np.searchsorted(hash_b, a.hash, "right") - left
    ends = np.cumsum(a.sizes)  # of each class among the entries of a
    made = np.concatenate([[0], np.cumsum(counts)])  # entries before each
    per_class = made[ends]
    first, nb = 0, len(b.idx)
    while first < len(a.idx):
        before = made[ends[first - 1]] if first else 0
        last = max(first + 1, int(np.searchsorted(per_class, before + _STRIP, "right")))
        lo, hi = (ends[first - 1] if first else 0), ends[last - 1]
        total = int(made[hi] - made[lo])
        if total > 4 * _STRIP:  # one class alone: hash by hash, into a place for each class of b
            sums = np.zeros((5, nb), np.int64)
            for e in range(lo, hi):
                at, s = owner_b[left[e] : left[e] + counts[e]], s_b[left[e] : left[e] + counts[e]]
                low, high = np.minimum(s, a.of_hash[e]), np.maximum(s, a.of_hash[e])
                for row, v in zip(sums, (1, low, low * low, high, high * high), strict=True):
                    row[at] += v
            some = np.flatnonzero(sums[0][: first if same else nb])
            yield np.full(len(some), first), some, *sums[:, some]
        elif total:
            c = counts[lo:hi]
            at = np.arange(total) + np.repeat(left[lo:hi] - (made[lo:hi] - made[lo]), c)
            entries = ((np.repeat(a.owner[lo:hi] - first, c) * nb + owner_b[at]) << np.int64(2 * _S_BITS)) | np.repeat(a.of_hash[lo:hi] << _S_BITS, c) | s_b[at]
            if same:
                pair = entries >> np.int64(2 * _S_BITS)
                entries = entries[pair // nb + first > pair % nb]
            if len(entries):
                entries.sort()
                pair = entries >> np.int64(2 * _S_BITS)
                s_1, s_2 = entries >> np.int64(_S_BITS) & ((1 << _S_BITS) - 1), entries & ((1 << _S_BITS) - 1)
                starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                low, high = np.minimum(s_1, s_2), np.maximum(s_1, s_2)
                inter = np.diff(np.concatenate([starts, [len(pair)]]))
                yield pair[starts] // nb + first, pair[starts] % nb, inter, *(np.add.reduceat(v, starts) for v in (low, low * low, high, high * high))
        first = last


def _figures(m: dict[str, np.ndarray], k: np.ndarray, figures: Sequence[str], jukes_cantor: bool, limit: float | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which pairs count, and their figures as whole numbers."""
    keep, shares = np.ones(len(k), bool), {}
    if limit is not None or any(f in SHARES for f in figures):
        shares = measured_arrays(m, k, jukes_cantor)
        if limit is not None:
            keep = shares["distance"] < limit
    return keep, {f: np.floor(shares[f] * MILLION + 0.5).astype(np.int64) if f in SHARES else m[f] for f in figures}


#: What a block's row holds: of each class, and of each of its shared hashes.
_LISTS = dict.fromkeys(("idx", "k", "m", "n", "sum_s", "sum_s2", "sizes", "hashes"), "bigint") | {"simplicities": "smallint"}


def _packed(classes: pa.Table, spread: pa.Table) -> pa.Table:
    """A block's classes that have links, in one row."""
    classes = classes.sort_by("idx")
    idx = classes.column("idx").to_numpy()
    owner = np.searchsorted(idx, spread.column("idx").to_numpy())
    order, sizes = np.argsort(owner, kind="stable"), np.bincount(owner, minlength=len(idx))
    some = (sizes > 0) | (classes.column("m").to_numpy() > 1)
    lists = {c: classes.column(c).to_numpy()[some] for c in ("idx", "k", "m", "n", "sum_s", "sum_s2")}
    lists |= {"sizes": sizes[some], "hashes": spread.column("hash").to_numpy()[order], "simplicities": spread.column("s").to_numpy()[order]}
    row = {"block": pa.array([classes.column("block")[0].as_py()], pa.int32())}
    for c, v in lists.items():
        row[c] = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v.astype(np.int16 if c == "simplicities" else np.int64)))
    return pa.table(row)


def _unpacked(batch: pa.RecordBatch, row: int, suffix: str) -> _Block:
    lists = {c: batch.column(c + suffix)[row].values for c in _LISTS}
    ends = pa.array(np.concatenate([[0], np.cumsum(lists.pop("sizes").to_numpy())]), pa.int32())
    return _Block(pa.table(lists | {c: pa.ListArray.from_arrays(ends, lists[c]) for c in ("hashes", "simplicities")}))


def block_count(n: int, rows: int, cores: int) -> int:
    """Blocks for n classes with rows shared hashes: few enough that what is sent stays near the sketches, many enough for all cores."""
    few = math.ceil(math.sqrt(4 * cores))
    return max(1, -(-n // _CLASSES), -(-rows // _ROWS), min(few, -(-n // 2048)))


def link_sums(sketches: Sketches | DataFrame, figures: Sequence[str], limit: float | None = None, jukes_cantor: bool = False) -> DataFrame:
    """(idx, name, class_idx, n_links, and F_sum, F_low, F_high of each figure F over the name's links), a row per name.

    figures: of MOMENTS and SHARES, the latter in millionths. class_idx is the least idx with the same sketch (a name without hashes is its own). limit: only links of a
    distance below it. Names without links have n_links 0 and nulls. sketches may also be rows as of sketch_rows(). Products of moments are in
    64 bits, enough for sketches of 70 million hashes.
    """
    one = by_name(sketches) if isinstance(sketches, Sketches) else sketches
    spark = one.sparkSession
    content = F.unhex(F.sha2(F.to_json(F.struct("hashes", "simplicities")), 256))
    one = saved(one.withColumn("content", F.when(F.col("n") > 0, content)), "links-names")
    classes = one.where("n > 0").groupBy("k", "content").agg(F.min(F.struct("idx", "n", "sum_s", "sum_s2")).alias("c"), F.count(F.lit(1)).alias("m"))
    classes = saved(classes.select("c.*", "k", "content", "m"), "links-classes")
    firsts = one.where("n > 0").join(classes.select("idx", "content"), ["idx", "content"], "left_semi").dropDuplicates(["idx", "content"])
    lists = firsts.select("idx", F.explode(F.arrays_zip("hashes", "simplicities")).alias("p")).select("idx", F.col("p.hashes").alias("hash"), F.col("p.simplicities").cast("short").alias("s"))
    spread = saved(lists.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("hash"))).where("_c > 1").drop("_c"), "links-hashes")
    n, rows = classes.count(), spread.count()
    blocks = block_count(n, rows, spark.sparkContext.defaultParallelism)
    place = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("block")
    kinds = {"k": "int"} | dict.fromkeys(("idx", "m", "n", "sum_s", "sum_s2", "hash"), "long") | {"s": "short"}

    def dealt(df: DataFrame) -> GroupedData:
        return df.select(place, *(F.col(c).cast(kinds[c]) for c in df.columns)).repartition(4 * blocks, "block").groupBy("block")

    pairs = dealt(classes.drop("content")).cogroup(dealt(spread)).applyInArrow(_packed, f"block int, {', '.join(f'{c} array<{x}>' for c, x in _LISTS.items())}")
    packed = saved(pairs, "links-blocks")

    def met(i: int, a: _Block, j: int, b: _Block) -> pa.Table:
        of_a = _Sums(a, figures)
        of_b = of_a if i == j else _Sums(b, figures)
        if i == j:  # the links within classes
            at = np.flatnonzero(a.m > 1)
            m = dict(zip(MOMENTS, (a.n[at], a.n[at], a.s[at], a.s2[at], a.s[at], a.s2[at]), strict=True))
            keep, values = _figures(m, a.k[at], figures, jukes_cantor, limit)
            of_a.add(at[keep], a.m[at][keep] - 1, {f: v[keep] for f, v in values.items()})
        for x, y, inter, low, low2, high, high2 in _met(a, b, i == j):
            m = dict(zip(MOMENTS, (inter, a.n[x] + b.n[y] - inter, a.s[x] + b.s[y] - low, a.s2[x] + b.s2[y] - low2, high, high2), strict=True))
            keep, values = _figures(m, a.k[x], figures, jukes_cantor, limit)
            keep = keep & (a.k[x] == b.k[y])
            if not keep.all():
                x, y, values = x[keep], y[keep], {f: v[keep] for f, v in values.items()}
            of_a.add(x, b.m[y], values)
            of_b.add(y, a.m[x], values)
        return (of_a.rows() if i == j else pa.concat_tables([of_a.rows(), of_b.rows()])).cast(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j = (batch.column(c)[row].as_py() for c in ("block", "block_b"))
                a = _unpacked(batch, row, "")
                yield from met(i, a, j, a if i == j else _unpacked(batch, row, "_b")).to_batches()

    names = ["idx", "n_links", *(f"{f}_{x}" for f in figures for x in ("sum", "low", "high"))]
    arrow = pa.schema([(c, pa.int64()) for c in names])
    other = packed.withColumnsRenamed({c: f"{c}_b" for c in packed.columns})
    both = packed.hint("shuffle_replicate_nl").join(other, F.col("block") >= F.col("block_b"))  # a task reads its blocks from the table: no copy of them is written
    found = both.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    sums = found.groupBy("idx").agg(F.sum("n_links").alias("n_links"), *(f(f"{c}_{x}").alias(f"{c}_{x}") for c in figures for x, f in (("sum", F.sum), ("low", F.min), ("high", F.max))))
    of_class = classes.join(sums, "idx", "left").select("k", "content", F.col("idx").alias("class_idx"), *names[1:])
    rows = one.join(of_class, ["k", "content"], "left")
    return rows.select("idx", "name", F.coalesce("class_idx", "idx").alias("class_idx"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *names[2:])
