"""N-gram Jaccard join with set-relation skipping.

Every document is a set of word shingles; documents whose sets overlap by the threshold are linked, and linked
documents form components. Equal sets are one class from the start. The index has a list per shingle, of the
classes that have it in their prefix under one global order, rarest first; shingles of a single class, most of
a corpus, never enter it, and a class with too many of them has no partner and is done.

Two relations between sets keep the work far from all pairs of a list:

* Answer skipping. Every class gets a home: a class that is highly similar to it, found through the lists that they share,
  or itself. The classes of a home are compared in blocks, and there no two sets are intersected: the home X is intersected
  with every set Z of a block, and the answers of a member Y follow from those of X by what sets Y apart from it,
  |Y and Z| = |X and Z| - |(X - Y) and Z| + |(Y - X) and Z|. Pairs that |X and Z| + |Y - X| already rules out are skipped.
* Index skipping. Between homes, lists are cut into blocks by set size, one entry a home and block. A pair of homes is sought in the
  list of the first shingle that a pair of their classes shares, where at most n - position shingles of either class can be
  shared; so an entry's position bounds the size of its partners, and the blocks beyond that are never joined. Homes
  whose own overlap and whose members' distances from them leave no link between their members are skipped; the
  few that remain are compared in blocks as above.

So every link between classes is found, a group of near copies is handed from task to task in blocks and answered in counts of links and
edges that are as many as its members, and no pair of classes is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean_memory, whole_row
from .tally import chunk_count, tallied
from .words import hashed_words, mix64, new_seed

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(column: pa.Array, width: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text: width words, or all of a text that has fewer; none without words."""
    hashes, _, _, first, _ = hashed_words(column, seed=seed)
    first = first.tolist()
    with np.errstate(over="ignore"):
        wide = max(0, len(hashes) - width + 1)
        rows = np.zeros(wide, np.uint64)
        for k in range(width):
            rows = mix64(rows * _STEPS[k] + hashes[k : k + wide])
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(rows[a : b - width + 1]))
            else:
                one = np.zeros(min(1, b - a), np.uint64)
                for k in range(b - a):
                    one = mix64(one * _STEPS[k] + hashes[a + k] + np.uint64(1))
                out.append(one)
    return out


def lists_of(rows: list[np.ndarray | None]) -> pa.Array:
    """An Arrow column of lists of 64-bit integers."""
    missing = np.array([x is None for x in rows], bool)
    values = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.int64)]).view(np.int64)
    bounds = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(missing, False)), pa.array(values))


def _with_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, chunk_bytes: int) -> DataFrame:
    """A row per input row: _id, n (its set's size), cls (its set's 128-bit name, null without words), and, where it is its chunk's
    first row of a class that can have partners, alone (its shingles that no other chunk or class has), apart (those at most a quarter as
    common as its median one: how far it is edited from what it was copied from) and tokens (all but alone, rarest first)."""
    chunks, seed = chunk_count(docs, text_col, chunk_bytes), new_seed()
    bits = min(64, 8 * -(-(max(1, chunks * max(chunks, chunk_bytes)).bit_length() + 7) // 8))
    high = np.uint64(((1 << bits) - 1) << (64 - bits))  # keys for counting: enough bits that few shingles share one; they only set the order

    def classes(table: pa.Table) -> tuple[list[np.ndarray], list[bytes | None], list[int]]:
        sets = shingle_sets(table.column("_text").combine_chunks(), width, seed)
        names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        seen: dict[bytes | None, int] = {None: -1}
        return sets, names, [k for k, x in enumerate(names) if seen.setdefault(x, k) == k]

    def ask(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets, _, own = classes(table)
        return np.unique(np.concatenate([sets[k] for k in own] or [np.zeros(0, np.uint64)]) & high, return_counts=True)

    def rarity(total: np.ndarray) -> np.ndarray:
        return np.minimum(255, np.ceil(4 * np.log2(np.maximum(total, 1))))

    def use(table: pa.Table, answers: np.ndarray, _: tuple[int, int, int]) -> pa.Table:
        sets, names, own = classes(table)
        flat = np.concatenate([sets[k] for k in own] or [np.zeros(0, np.uint64)]) & high
        level = answers[np.unique(flat, return_inverse=True)[1]] if len(flat) else answers[:0]
        alone: list[int | None] = [None] * len(sets)
        apart: list[int | None] = [None] * len(sets)
        tokens: list[np.ndarray | None] = [None] * len(sets)
        at = 0
        for k in own:
            s = sets[k]
            of = level[at : at + len(s)]
            at += len(s)
            shared = of > 0
            m = int(shared.sum())
            if 100 * m >= percent * len(s):
                alone[k] = len(s) - m
                apart[k] = int((of + 8 < np.median(of)).sum())
                tokens[k] = s[shared][np.argsort(of[shared], kind="stable")].view(np.int64)
        return pa.table(
            [table.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(alone, pa.int64()), pa.array(apart, pa.int64()), lists_of(tokens)],
            ["_id", "n", "cls", "alone", "apart", "tokens"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return tallied(docs, id_col, text_col, chunks, ask, use, f"_id {kind}, n long, cls binary, alone long, apart long, tokens array<long>", np.uint8, rarity)


def _enough(overlap: Column, a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, for sets of sizes a and b."""
    return overlap * (100 + percent) >= (a + b) * percent


def _least_partner(percent: int) -> Column:
    return F.ceil(F.col("n") * percent / 100)


def _largest_partner(percent: int) -> Column:
    """The largest set that an entry (n, pos) can link with if its shingle is the first that they share: then at most n - pos are shared."""
    left = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    return F.least(left, F.floor(F.col("n") * 100 / percent))


def _band(size: Column) -> Column:
    """The block of a list that holds sets of this size; blocks are a fiftieth wide."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1.02))).cast("int")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with na, nb and the size of their intersection."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").withColumn("overlap", F.size(F.array_intersect("ta", "tb")).cast("long")).drop("ta", "tb")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) reach from each node, by hooking and pointer jumping on written tables."""
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    state = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "state0")
    k = 0
    while True:
        k += 1
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = state.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        above = state.select(F.col("node").alias("low"), F.col("root").alias("up"))
        new = scratch.save(hooked.join(above, "low").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), f"state{k}")
        going = bool(new.where("moved").head(1))
        scratch.drop(f"state{k - 1}")
        state = new.select("node", "root")
        if not going:
            scratch.drop("both")
            return state


#: How much of its union with its home a class shares at least, in percent; the result does not depend on it.
_HOME = 50


def _homes(scratch: Scratch, index: DataFrame, sets: DataFrame, rounds: int) -> DataFrame:
    """(cls, home) for each class of the index; a home is a class, itself or one that is similar.

    In each list the least edited class offers itself; a class is compared with the one that offers itself in most of its lists.
    """
    homes = scratch.save(index.select("cls").distinct().withColumn("home", F.col("cls")), "homes0")
    for r in range(rounds):
        named = index.join(homes, "cls")
        first = F.min(F.struct("apart", F.xxhash64("cls", F.lit(r)).alias("order"), "cls", "n", "home"))
        offers = named.groupBy("token").agg(first.alias("h"), F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo != hi").select("token", "h.*")
        x, h = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"h.{c}"))
        near = named.alias("x").join(offers.alias("h"), "token").where((x("home") != h("home")) & (F.least(x("n"), h("n")) * 100 >= F.greatest(x("n"), h("n")) * _HOME))
        votes = near.groupBy(x("cls").alias("b"), h("cls").alias("a"), h("home").alias("to")).agg(F.count(F.lit(1)).alias("lists"))
        pairs = votes.groupBy("b").agg(F.max(F.struct("lists", "a", "to")).alias("s")).select("b", "s.a", "s.to")
        similar = _overlaps(pairs, sets).where(_enough(F.col("overlap"), F.col("na"), F.col("nb"), _HOME))
        moved = scratch.save(homes.join(similar.select(F.col("b").alias("cls"), "to"), "cls", "left").select("cls", F.coalesce("to", "home").alias("home")), f"moved{r}")
        above = moved.select(F.col("cls").alias("home"), F.col("home").alias("to"))
        homes = scratch.save(moved.join(above, "home", "left").select("cls", F.coalesce("to", "home").alias("home")), f"homes{r + 1}")
        scratch.drop(f"moved{r}", f"homes{r}")
    return homes


def block_links(x: np.ndarray, y: list[np.ndarray], ny: np.ndarray, z: list[np.ndarray], nz: np.ndarray, percent: int, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(links, added): which sets y link with which z, as a table of booleans, and how much of each y is not in x.

    Sets are arrays of distinct shingles without those that no other set has; ny and nz are their whole sizes. The answers of
    each y follow from those of x by what sets y apart from x.
    """
    x = np.sort(x)

    def place(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(x, flat), max(0, len(x) - 1))
        return at, x[at] == flat if len(x) else np.zeros(len(flat), bool)

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        size = np.array([len(s) for s in sets], np.int64)
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        at, inside = place(flat)
        return size, flat, row, at, inside, np.bincount(row[inside], minlength=len(sets))

    size_y, flat_y, row_y, at_y, in_y, xy = rows(y)
    size_z, flat_z, row_z, at_z, in_z, xz = rows(z)
    added = size_y - xy
    need = percent * (ny[:, None] + nz[None, :])
    most = np.minimum(np.minimum(xz[None, :] + added[:, None], xy[:, None] + (size_z - xz)[None, :]), np.minimum(size_y[:, None], size_z[None, :]))
    links = (100 + percent) * most >= need
    some_y, some_z = links.any(1), links.any(0)
    if not some_y.any():
        return links, added
    new_y, new_z = np.cumsum(some_y) - 1, np.cumsum(some_z) - 1
    shape_y, shape_z = int(some_y.sum()), int(some_z.sum())
    overlap = np.repeat(xz[some_z][None, :].astype(np.float32), shape_y, 0)
    use_y, use_z = some_y[row_y], some_z[row_z]
    # what x has and a y lacks: columns that every y has are left out
    has = np.bincount(at_y[in_y & use_y], minlength=len(x))
    lacked = np.flatnonzero(has < shape_y)
    column = np.full(len(x), -1)
    column[lacked] = np.arange(len(lacked))

    def table(n_rows: int, row: np.ndarray, col: np.ndarray, lo: int, wide: int) -> np.ndarray:
        out = np.zeros((n_rows, wide), np.float32)
        own = (col >= lo) & (col < lo + wide)
        out[row[own], col[own] - lo] = 1
        return out

    keep_y, keep_z = in_y & use_y, in_z & use_z
    row1, col1, row2, col2 = new_y[row_y[keep_y]], column[at_y[keep_y]], new_z[row_z[keep_z]], column[at_z[keep_z]]
    for lo in range(0, len(lacked), columns):
        wide = min(columns, len(lacked) - lo)
        overlap -= (1 - table(shape_y, row1, col1, lo, wide)) @ table(shape_z, row2, col2, lo, wide).T
    # what a y has and x lacks
    keep_y, keep_z = ~in_y & use_y, ~in_z & use_z
    extra = np.intersect1d(flat_y[keep_y], flat_z[keep_z])
    if len(extra):
        def extras(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(extra, flat), len(extra) - 1)
            own = extra[at] == flat
            return row[own], at[own]

        (row1, col1), (row2, col2) = extras(flat_y[keep_y], new_y[row_y[keep_y]]), extras(flat_z[keep_z], new_z[row_z[keep_z]])
        for lo in range(0, len(extra), columns):
            wide = min(columns, len(extra) - lo)
            overlap += table(shape_y, row1, col1, lo, wide) @ table(shape_z, row2, col2, lo, wide).T
    links[np.ix_(some_y, some_z)] &= (100 + percent) * overlap.astype(np.int64) >= need[np.ix_(some_y, some_z)]
    return links, added


def least_labels(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a table of links, a number that those which links connect share: the least row among them, or -1 without a link."""
    n = len(links)
    row, col = np.where(links.any(1), np.arange(n), n), np.full(links.shape[1], n)
    while True:
        col = np.where(links, row[:, None], n).min(0, initial=n)
        new = np.minimum(row, np.where(links, col[None, :], n).min(1, initial=n))
        if (new == row).all():
            return np.where(row < n, row, -1), np.where(col < n, col, -1)
        row = new


_TASK = ("hx", "hy", "i", "j")


def _block_answers(tasks: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, others, home, added) for the blocks of classes that tasks (hx, hy, i, j) compare: block i of home hx with block j of home hy.

    A class a with links has a row with b, a class that they connect it with, and others, the members of those it links with; where a block meets
    itself, every class has a row with its home and added, what of it its home lacks.
    """
    side = lambda h, k: members.select(F.col("home").alias(h), F.col("block").alias(k), "cls", "n", "members", "tokens")
    columns = [*_TASK, "side", "cls", "n", "members", "tokens"]
    y = tasks.join(side("hx", "i"), ["hx", "i"]).withColumn("side", F.lit(0)).select(columns)
    z = tasks.where("hx != hy or i != j").join(side("hy", "j"), ["hy", "j"]).withColumn("side", F.lit(1)).select(columns)
    home = tasks.join(sets.select(F.col("cls").alias("hx"), F.col("cls"), "n", "tokens"), "hx").withColumn("side", F.lit(2)).withColumn("members", F.lit(0).cast("long")).select(columns)

    def compare(table: pa.Table) -> pa.Table:
        lean_memory("")
        table = table.combine_chunks()
        which = table.column("side").to_numpy()
        n, weight = table.column("n").to_numpy(), table.column("members").to_numpy()
        lists = table.column("tokens").combine_chunks()
        bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        names = table.column("cls").combine_chunks()
        of = [np.flatnonzero(which == k) for k in range(3)]
        same = not len(of[1]) and table.column("hx")[0] == table.column("hy")[0] and table.column("i")[0] == table.column("j")[0]
        if same:
            of[1] = of[0]
        out: list[tuple] = []
        if len(of[0]) and len(of[1]):
            sets = [[values[bounds[k] : bounds[k + 1]] for k in part.tolist()] for part in of]
            links, added = block_links(sets[2][0], sets[0], n[of[0]], sets[1], n[of[1]], percent)
            if same:
                out.append((of[0], None, None, table.column("hx")[0].as_py(), added))
                np.fill_diagonal(links, True)  # the two sides are the same classes
            row, col = least_labels(links)
            if same:
                np.fill_diagonal(links, False)
            for part, label, others in ((of[0], row, links @ weight[of[1]]), *(() if same else ((of[1], col, weight[of[0]] @ links),))):
                some = np.flatnonzero(others)
                out.append((part[some], of[0][label[some]], others[some], None, None))
        parts = []
        for a, b, others, home, added in out:
            k = len(a)
            parts.append(pa.table([
                names.take(pa.array(a)), pa.nulls(k, pa.binary()) if b is None else names.take(pa.array(b)), pa.nulls(k, pa.int64()) if others is None else pa.array(others.astype(np.int64)),
                pa.array([home] * k, pa.binary()), pa.nulls(k, pa.int64()) if added is None else pa.array(added.astype(np.int64)),
            ], schema=_ANSWER))
        return pa.concat_tables(parts) if parts else _ANSWER.empty_table()

    return y.unionByName(z).unionByName(home).groupBy(*_TASK).applyInArrow(compare, "a binary, b binary, others long, home binary, added long")


_ANSWER = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("others", pa.int64()), ("home", pa.binary()), ("added", pa.int64())])


def _links(scratch: Scratch, index: DataFrame, sets: DataFrame, percent: int, rounds: int, block: tuple[int, int]) -> DataFrame:
    """(a, b, others): every class that links with others, with classes that links connect it with and the members of those it links with, in parts."""
    homes = _homes(scratch, index, sets, rounds)
    sized = homes.join(sets.select("cls", "n", "members", F.size("tokens").alias("size")), "cls")
    stats = sized.groupBy("home").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"), F.greatest(F.ceil(F.count(F.lit(1)) / block[0]), F.ceil(F.sum("size") / block[1])).cast("int").alias("blocks"))
    stats = scratch.save(stats, "stats")
    members = scratch.save(
        homes.join(stats, "home").join(sets.select("cls", "n", "members", "tokens"), "cls").select("home", F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("block"), "cls", "n", "members", "tokens"), "members"
    )
    some = stats.where("classes > 1")
    own = some.select(F.col("home").alias("hx"), F.col("home").alias("hy"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    own = own.select("hx", "hy", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    inside = scratch.save(_block_answers(own, members, sets, percent), "inside")
    # between homes: an entry for each list, home and block of sizes
    entries = index.join(homes, "cls").withColumn("cap", _largest_partner(percent)).where(F.col("cap") >= _least_partner(percent)).withColumn("band", _band(F.col("n")))
    entries = entries.groupBy("token", "home", "band").agg(F.min("n").alias("n"), F.max("cap").alias("cap"))
    several = entries.groupBy("token").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo != hi").select("token")
    entries = scratch.save(entries.join(several, "token", "left_semi"), "entries")
    seeking = entries.withColumn("band", F.explode(F.sequence(_band(_least_partner(percent)), _band(F.col("cap")))))
    meet = seeking.alias("x").join(entries.alias("y"), ["token", "band"])
    meet = meet.where((F.col("x.home") < F.col("y.home")) & (F.col("y.n") <= F.col("x.cap")) & (F.col("x.n") <= F.col("y.cap")))
    pairs = scratch.save(meet.select(F.col("x.home").alias("a"), F.col("y.home").alias("b")).distinct(), "pairs")
    far = stats.join(inside.where("home is not null").groupBy("home").agg(F.max("added").alias("added")), "home", "left").select("home", "blocks", "least", F.coalesce("added", F.lit(0)).alias("added"))
    of = lambda h, k: far.select(F.col("home").alias(h), *(F.col(c).alias(f"{c}{k}") for c in ("blocks", "least", "added")))
    # two classes share at most what their homes share and what each has beyond its home
    near = _overlaps(pairs, sets).join(of("a", 1), "a").join(of("b", 2), "b")
    near = near.where(_enough(F.col("overlap") + F.col("added1") + F.col("added2"), F.col("least1"), F.col("least2"), percent))
    near = near.select(F.col("a").alias("hx"), F.col("b").alias("hy"), F.explode(F.sequence(F.lit(0), F.col("blocks1") - 1)).alias("i"), "blocks2")
    near = scratch.save(near.select("hx", "hy", "i", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("j")), "near")
    between = scratch.save(_block_answers(near, members, sets, percent), "between")
    return inside.unionByName(between).where("b is not null").select("a", "b", "others")


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rounds: int = 2,
    chunk_bytes: int = 8 << 20, block: tuple[int, int] = (256, 1 << 19),
) -> DataFrame:
    """A row per input row: id, n_shingles, component_id, class_id, n_links.

    Words are runs without the six ASCII white-space characters, ASCII case folded. Two rows link if 100 *
    intersection >= percent * union of their shingle sets; component_id is the smallest id that links reach, class_id
    the smallest id with the same set, n_links the number of other rows that the row links with. Shingles are compared as 64-bit
    hashes. Null and empty texts, and texts of white space, have no shingles and link with nothing, also among each other: their
    component_id is their id. Null ids are passed over in the smallest id (null if there is no other); repeated rows are members of
    the same class and link; an empty table gives an empty result; other columns are not read. Texts are used whole.
    rounds: of looking for homes; block: the classes and shingles that blocks of a home have, about.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = scratch.save(_with_sets(docs, id_col, text_col, width, percent, chunk_bytes), "rows")
    classes = scratch.save(rows.where("cls is not null").groupBy("cls").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("members")), "classes")
    one = rows.where("tokens is not null").select("cls", "n", "alone", "apart", "tokens").dropDuplicates(["cls"])
    sets = scratch.save(one.join(classes.select("cls", "members"), "cls"), "sets")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory("")
        for batch in batches:
            n, alone = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            lists = batch.column(4)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            take = np.clip(n - (percent * n + 99) // 100 + 1 - alone, 0, np.diff(bounds))
            row = np.repeat(np.arange(len(n)), take)
            k = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            source = pa.array(row)
            columns = [lists.values.take(pa.array(bounds[row] + k)), batch.column(0).take(source), pa.array(n[row]), pa.array(alone[row] + k), batch.column(3).take(source)]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "cls", "n", "pos", "apart"])

    entries = sets.select("cls", "n", "alone", "apart", "tokens").mapInArrow(prefixes, "token long, cls binary, n long, pos long, apart long")
    index = scratch.save(entries, "index")
    found = scratch.save(_links(scratch, index, sets, percent, rounds, block), "links")
    scratch.drop("index", "sets", "members", "inside", "between", "entries", "pairs", "near", "stats", f"homes{rounds}")
    roots = components(scratch, found.where("a != b").select("a", "b"))
    others = found.groupBy(F.col("a").alias("cls")).agg(F.sum("others").alias("others"))
    named = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").join(others, "cls", "left")
    named = named.select("cls", F.coalesce("root", "cls").alias("root"), "class_id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    named = scratch.save(named, "named")
    groups = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    of_class = scratch.save(named.join(groups, "root").select("cls", "class_id", "component_id", "n_links"), "of_class")
    scratch.drop("links", "classes", "named")
    return rows.select("_id", "n", "cls").join(of_class, "cls", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns of docs: the one with the smallest id, null ids last, and of rows with the same id any one.

    Rows are told apart by themselves and not by their ids: of rows with the same id and different texts each is kept or dropped for its
    own text. Rows without words are kept; repeated rows are one component and one of them stays; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("_row"), whole_row(docs)), "rows")
    one = rows.select("_row", F.col("_all").getField(id_col).alias("_i"), F.col("_all").getField(text_col).alias("_t"))
    keyed = one.select(F.struct(F.when(F.col("_i").isNull(), 1).alias("x"), F.col("_i").alias("i"), F.col("_row").alias("r")).alias("_key"), "_t")
    found = ngram_join(keyed, "_key", "_t", width, percent)
    kept = found.where(F.col("_key") == F.col("component_id")).select(F.col("_key.r").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_all.*")
